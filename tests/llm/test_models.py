"""Language identification, quality, page text and vector search against held-out labels or brute force."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import html_text, language_id, quality, vector_search


# Language identification.


def test_languages_of_held_out_rows(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    out = language_id.identify(documents).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    print("languages right:", sum(r["lang_pred"] == truth[r["doc_id"]] for r in held), len(held))
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_languages_odd(odd, nothing):
    out = language_id.identify(odd)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows, texts = out.collect(), odd.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und >= {2, 3, 6, 9} and not und & {1, 4, 5, 7, 8}
    assert language_id.identify(nothing).count() == 0
    kept = language_id.drop_unidentified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 4, 5, 7, 8}
    assert language_id.drop_unidentified(nothing).count() == 0


def test_nothing_learned_drops_texts_without_letters_only(odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = [r["doc_id"] for r in language_id.drop_unidentified(unlabelled).collect()]
    want = [r["doc_id"] for r in odd.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert len(want) > 5 and sorted(map(str, kept)) == sorted(map(str, want))


def spaced(text):
    text = text.lower()
    return "".join(c if c.isalpha() else " " if not k or text[k - 1].isalpha() else "" for k, c in enumerate(text))


def brute_phrases(known, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize(("dense", "few", "block"), [(64, 24, 4096), (64, 24, 7), (3, 0, 64), (2, 24, 16), (64, 0, 9)])
def test_phrases_are_longest_matches(monkeypatch, dense, few, block):
    for name, value in (("DENSE", dense), ("FEW", few), ("BLOCK", block)):
        monkeypatch.setattr(language_id, name, value)
    draw = random.Random(block)
    for letters in ("abc ", "ab  \u4e2d\u6587\u5b57", "xyz\u00e9\u00df. \U0001d7d8"):
        word = lambda n: "".join(draw.choices(letters, k=n))  # noqa: B023, E731
        sample = {lang: word(draw.randint(1, 60)) for lang in "pqr"} | {"s": "aaa"}
        texts = [*(word(draw.randint(0, 200)) for _ in range(20)), sample["p"] * 3, sample["q"][3:], "", None, "a" * 100, "1 2", "the lazy " * 300]
        parser = language_id.Parser(sample)
        counts, lengths = parser.phrases(texts)
        for text, row, n in zip(texts, counts, lengths):
            assert n == len(spaced(text or ""))
            assert row.tolist() == [brute_phrases(spaced(f" {sample[lang]} "), spaced(text or "")) for lang in parser.langs], text
        for text, (lang, score) in zip(texts, parser.predict(texts)):
            if any(map(str.isalpha, text or "")):
                size = len(spaced(text))
                bits = {x: brute_phrases(spaced(f" {sample[x]} "), spaced(text)) * math.log2(max(2, len(spaced(f" {sample[x]} ")))) / size for x in parser.langs}
                best = min(bits.values())
                assert lang == min(x for x in bits if math.isclose(bits[x], best)) and 0 < score <= 1
            else:
                assert (lang, score) == ("und", 0.0)


def scripts(seed):
    """Invented words of several scripts; each language has more letters than a state has columns, or few."""
    draw = random.Random(seed)
    ranges = {"zh": (0x4E00, 900), "ja": (0x3041, 170), "ko": (0xAC00, 800), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x627, 36), "hi": (0x905, 50), "en": (0x61, 26), "tr": (0x61, 26)}
    out = {}
    for lang, (first, n) in ranges.items():
        words = ["".join(chr(first + draw.randrange(n)) for _ in range(draw.randint(1, 6))) for _ in range(400)]
        out[lang] = lambda k, words=words: " ".join(draw.choices(words, k=k))
    return out


def test_languages_of_any_script(spark):
    made = scripts(8)
    rows = [(k, text(60), lang) for k, (lang, text) in enumerate((lang, text) for lang, text in made.items() for _ in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    truth = {k: lang for k, _, lang in rows}
    found = language_id.identify(df).collect()
    assert all(truth[r["doc_id"]] == r["lang_pred"] and r["score"] > 0.5 for r in found)
    assert any(r["held_out"] for r in found)
    # What a sample holds word for word is of its language.
    samples = language_id.samples(df, "doc_id", "text", "lang", F.lit(True))
    assert set(samples) == set(made)
    parser = language_id.Parser(samples)
    assert [lang for lang, _ in parser.predict([x[500:900] for x in samples.values()])] == list(samples)


def test_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 500)
    long, copies = [(1, "x" * 900, "a")], [(7, "many rows of one id", "b")] * 300
    rows = [*long, *copies, (None, None, "b"), *((None, f"null id {k}", "c") for k in range(300)), *((k, f"row {k}", "d") for k in range(300))]
    out = language_id.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "doc_id", "text", "lang", F.lit(True))
    assert out["a"] == "x" * 500 and out["b"] == "many rows of one id"
    assert all(len(x) <= 500 for x in out.values()) and len(out["c"]) > 400 and len(out["d"]) > 400


# Quality.


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_of_held_out_rows(documents, labels):
    out = {r["doc_id"]: r for r in quality.score_quality(documents, labels).collect()}
    assert len(out) == documents.count()
    right = {0: [], 1: []}
    for r in labels.collect():
        got = out[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= got["score"] <= 1 and got["predicted"] == (got["score"] >= 0.5)
        if got["held_out"]:
            right[r["quality"]].append(got["predicted"] == r["quality"])
    print("quality right:", {k: (sum(v), len(v)) for k, v in right.items()})
    assert sum(right[0]) / len(right[0]) > 0.85 and sum(right[1]) / len(right[1]) > 0.9


def test_quality_odd(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 1), (6, 0), (None, 1), (9, None), (99, 1)], "doc_id long, quality int")
    out = quality.score_quality(odd, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == odd.count()
    assert {r["score"] for r in quality.score_quality(odd, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(nothing, labels).count() == 0


# Pages.

ARTICLE = "<article><h1>Title &amp; more</h1><p>First\n  para.<br>next<p><b>Second</p><ul><li>one</li><li>two</li></ul></article>"
WANT = "Title & more First para. next Second one two"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body><script>var a='<p>x</p>'</script></body>", ""),
        (f"<body><nav><a>Home</a></nav>{ARTICLE}<footer>foot</footer></body>", WANT),
        (f"<header>top</header><div class='ad'>buy <div>now</div></div>{ARTICLE}<aside>side</aside>", WANT),
        (f"<div id=cookie-notice>ok?</div>{ARTICLE[:-10]}<section class='comments'><p>nice</p></section></article><form>x<input></form>", WANT),
        (f"{ARTICLE}<article class=comment>me too</article>", WANT),
        (f"<p class=notice>read this{ARTICLE}", WANT),
        ("<article><p>cut of", "cut of"),
        ("<article><p>a&nbsp;&#8212;&lt;b&gt;</p><style>p{}</style>c</article>", "a —<b> c"),
        ("<body><ul class=menu><li>m</li></ul><div><p>A long paragraph of text that says a lot about things.</p><p>And another, also long enough to count.</p></div><div id=footer>f</div><a>x</a> <a>y</a>", "A long paragraph of text that says a lot about things. And another, also long enough to count."),
        ("plain text only", "plain text only"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


LONG = "Many plain words make a long paragraph of the body here. " * 4
CARDS = "".join(f"<article><h3><a href=x>Card {i}</a></h3><p>A short teaser.</p></article>" for i in range(6))
LINKS = "<ul>" + "".join(f"<li><a href=x>Other {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><div>{LONG}</div><div>{LONG}</div><div>{LONG}</div>{CARDS}", LONG * 3),
        (f"<article><h1><a href=x>T</a></h1><p>{LONG}</p>{LINKS}<p>{LONG}</p><p>End.</p></article><div>Said by few.</div>", f"T {LONG * 2} End."),
        (f"<article><p>{LONG}</p></article>{CARDS}", LONG),
        ("<div>A notice of one line that is longer than any line of the poem.</div><article>" + "<p>Short is the line.</p>" * 9 + "</article>", "Short is the line. " * 9),
        (f"<main>{LINKS}</main>", " ".join(f"Other {i}" for i in range(8))),
    ],
)
def test_main_text_by_ratios(html, want):
    assert html_text.main_text(html) == " ".join(want.split())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div class='content-sidebar-wrap'>{ARTICLE}<div class=sidebar>s</div></div>", WANT),
        (f"<div class='layout-with-sidebar'><p>{LONG}</p><div id=sidebar>s</div></div><p>By us.</p>", LONG),
        (f"<html><head><title>t</title><meta name=x><body>{ARTICLE}</body></html>", WANT),
        (f"<head><noscript><div>no</div></noscript><title>t</title><div>{LONG}</div>", LONG),
        (f"<p>{LONG}</p><div class=related>{CARDS}</div><div id=comments>{LONG * 9}</div>", LONG),
    ],
)
def test_main_text_in_wrappers(html, want):
    assert html_text.main_text(html) == " ".join(want.split())


def test_pages_of_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == pages.count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "track(" not in r["text"] for r in out.collect())
    odd = spark.createDataFrame([(1, None, None, 2), (None, "u", ARTICLE, 3), (None, "u", ARTICLE, 3)], "page_id long, url string, html string, text long")
    assert sorted(tuple(r) for r in html_text.extract(odd).fillna(0).fillna("").collect()) == [(0, "u", WANT, len(WANT))] * 2 + [(1, "", "", 0)]
    assert html_text.extract(odd.where("false")).count() == 0


def test_quality_of_many_rows_of_one_id(spark):
    """The rows that labels bring along stay within the bound where ids repeat."""
    good, bad = "Plain words make up a sentence, and it ends well.", "$$$ WIN!!! %%% 777 @@ ||"
    rows = [(7, f"{good} {k}") for k in range(400)] + [(8, f"{bad} {k}") for k in range(400)] + [(None, good)] * 50 + [(k, good if k % 2 else bad) for k in range(20, 60)]
    labels = [(7, 1), (8, 0), (None, 1), (7, 1)] + [(k, k % 2) for k in range(20, 60)]
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    sizes, fit = [], quality.fit
    try:
        quality.fit = lambda x, y, *more: sizes.append(len(x)) or fit(x, y, *more)
        out = quality.score_quality(documents, marks, sample=60).collect()
    finally:
        quality.fit = fit
    assert len(out) == len(rows) and 20 < sizes[0] < 240
    assert all(r["predicted"] == (r["doc_id"] != 8 and (r["doc_id"] in (7, None) or r["doc_id"] % 2)) for r in out)


@pytest.mark.parametrize("page", ['<body><div class="layout has-sidebar"><article>{}</article></div></body>', '<body><nav><a href="/">x</a></nav><article class="post no-comments">{}</article></body>', '<body><div id="page" class="menu-open"><article>{}</article></div></body>', '<body><div class="menu-open"><div>{}</div></div></body>', '<body><main class="no-sidebar">{}</main><div class="comments">{}</div></body>'])
def test_wrappers_named_like_furniture_are_kept(page):
    text = "This is the body of the article, with words enough to count. " * 5
    assert html_text.main_text(page.format(f"<p>{text}</p>", "<p>What a reader says.</p>")) == text.strip()
    assert html_text.main_text('<body><div class="comments"><p>Only readers speak here.</p></div></body>') == ""


# Vector search.


def brute(rows, is_query, k=5):
    kept = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in {i: (i, v) for i, v in sorted(kept, reverse=True) if is_query(i)}.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i and len(w) == len(v))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    assert {tuple(r) for r in vector_search.search(table, F.col("vec_id") % 50 == 0).collect()} == want
    assert {tuple(r) for r in vector_search.search(table.repartition(7), F.col("vec_id") % 50 == 0, query_bytes=1500).collect()} == want


def test_vectors_far_and_alike(spark):
    """Components near and beyond 64 bits, and a vector that most rows have."""
    draw = random.Random(2)
    rows = [(k, [draw.choice((-1, 1)) * (2.0 ** draw.randint(0, 22) + draw.random()) for _ in range(3)]) for k in range(120)]
    rows += [(k, [0.5, 0.25, -1.0]) for k in range(200, 700)] + [(250, [0.5, 0.25, -1.0])] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in vector_search.search(df, F.col("vec_id") % 50 == 0).collect()} == brute(rows, lambda i: i % 50 == 0)
    far = spark.createDataFrame([(0, [1e30]), (1, [1e18]), (2, [-1e18]), (3, [2.0])], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r["score"] for r in vector_search.search(far, F.col("vec_id") == 0).collect()}
    assert out == {1: 2**63 - 1, 2: -(2**63), 3: 2**63 - 1}


def test_vectors_odd(spark):
    rows = [(0, [0.5, -0.5]), (1, [0.25, 0.0]), (2, [0.25, 0.0]), (2, [0.25, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (50, [0.1, 0.2, 0.3]), (51, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (100, []), (150, [-1.0, 1.0]), (150, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    out = vector_search.search(df, F.col("vec_id") % 50 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and {tuple(r) for r in out.collect()} == brute(rows, lambda i: i % 50 == 0)
    assert vector_search.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
