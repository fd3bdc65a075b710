"""Repeated strings and near duplicates against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import near_dedup, repeats
from spanloom.llm.shingles import shingles


def brute_repeats(rows):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        seen.update(raw[k : k + 400] for k in range(len(raw) - 399))
    passages = defaultdict(set)
    words = [r.split() for _, r in raws]
    for n, own in enumerate(words):
        for k in range(len(own) - 50):
            passages[tuple(own[k : k + 51])].add(n)
    out = Counter()
    for n, (i, raw) in enumerate(raws):
        shared = {j for k in range(len(words[n]) - 50) if len(passages[tuple(words[n][k : k + 51])]) > 1 for j in range(k, k + 51)}
        gone = bytearray(len(raw))
        for k in range(len(raw) - 399):
            if seen[raw[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest(), len(shared)] += 1
    return out


def planted(seed):
    """Texts with passages of about the least length, copies with edits, periodic and repeated texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé", k=draw.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(120)[:n] for n in (398, 399, 400, 401, 430, 650)]
    rows = []
    for i in range(60):
        own = text(draw.randint(0, 300))
        for p in draw.choices(passages, k=draw.randint(0, 3)):
            at = draw.randint(0, len(own))
            own = own[:at] + p + own[at:]
        if i % 5 == 4:
            own = rows[-1][1]
            for _ in range(draw.randint(0, 3)):
                at = draw.randint(0, max(0, len(own) - 1))
                own = own[:at] + "#" + own[at + 1 :]
        rows.append((i, own))
    rows += [(60, "ab" * 500), (61, "x" * 900), (62, "x" * 399), (63, None), (64, ""), (None, rows[7][1]), (7, rows[7][1]), (65, ("abc" * 200) + text(100) + ("abc" * 150))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_planted(spark, seed, monkeypatch):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"]
    assert Counter(tuple(r) for r in out.collect()) == brute_repeats(rows)


def test_anchors_do_not_depend_on_segments(monkeypatch):
    text = ("lorem ipsum dolor sit amet, " * 40 + "".join(random.Random(3).choices("abcdef ", k=5000))).encode()
    for kind, units in ((repeats.BYTES, np.frombuffer(text, "uint8")), (repeats.WORDS, repeats.words_of([text])[2][0])):
        length = repeats.SCALES[kind].length

        def chosen(kind=kind, units=units, length=length):
            made = [repeats.anchors(parts, kind) for parts in repeats.parted([units[:0], units, units[:500]], length)]
            return {(t, p + d, p, g) for x in made for t, p, low, high, g, _ in zip(*x) for d in range(low, high + 1)}

        monkeypatch.setattr(repeats, "TOGETHER", 1 << 18)
        whole = chosen()
        assert {s for t, s, _, _ in whole if t == 1} == set(range(len(units) - length + 1))
        monkeypatch.setattr(repeats, "TOGETHER", 700)
        assert chosen() == whole


def test_names_tell_strings_apart():
    """Sums of powers modulo 2^64 give these two words one value, whatever the base."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
        if len(a) >= 1024:
            assert len({*shingles(a, 4).tolist(), *shingles(b, 4).tolist()}) == 2
            ids = [repeats.strings(repeats.buckets(np.frombuffer(x.encode(), "uint8"), repeats.BYTES), 64, np.array([0]), np.array([700]))[0] for x in (a, b)]
            assert ids[0] != ids[1]


def test_repeats_of_tables(spark, odd, nothing):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for rows in (df, odd.where("doc_id is null or doc_id < 4 or doc_id > 5")):
        assert Counter(tuple(r) for r in repeats.remove_repeats(rows).collect()) == brute_repeats([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert {(r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in repeats.remove_repeats(odd.where("doc_id in (4, 5)")).collect()} == {(4, True), (5, True)}
    assert repeats.remove_repeats(nothing).count() == 0


def brute_near(rows, width=4, percent=80):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for n, own in enumerate(sets):
        counts = Counter(m for s in own for m in inverted[s])
        for m, both in counts.items():
            if 100 * both >= percent * (len(own) + len(sets[m]) - both):
                parent[find(n)] = find(m)
        for s in own:
            inverted[s].append(n)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        least[find(n)].append(i)
    names = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return Counter((i, len(sets[n]), names[find(n)], i == names[find(n)]) for n, (i, _) in enumerate(rows))


def test_listed_anchors_are_freed(spark, monkeypatch):
    freed, forget = [], repeats.forget
    monkeypatch.setattr(repeats, "forget", lambda session, path: (freed.append((path, session.read.parquet(path).columns)), forget(session, path)))
    rows = planted(1)
    assert Counter(tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_repeats(rows)
    assert ["who" in columns for _, columns in freed] == [True] + [False] * repeats.LEVELS
    assert not any(os.path.exists(path.removeprefix("file:")) for path, _ in freed)


def test_near_copies_of_tables(documents, odd, nothing):
    for df in (documents, odd):
        out = near_dedup.near_duplicates(df, width=4)
        assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert Counter(tuple(r) for r in out.collect()) == brute_near([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns


def test_near_copies_in_blocks(spark, monkeypatch):
    """A chain of edits: its ends are far apart, and its family is larger than a block."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(words)))
        words[draw.randrange(200)] = f"w{i}"
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(df, width=4).collect()) == brute_near(rows)


def test_large_groups_take_rows_in_proportion(spark, monkeypatch):
    """One bucket of a template's copies, far more than a block holds, with some rows that are linked to few others."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    template = [word() for _ in range(120)]
    rows = []
    for i in range(240):
        own = list(template)
        own[draw.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(own)))
    for i in range(240, 260):  # about as near as a margin lets through, not linked
        own = list(template)
        for k in range(0, 120, 24):
            own[(k + i) % 120] = f"v{i}.{k}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 24)
    seen = []
    inner = near_dedup.by_part
    monkeypatch.setattr(near_dedup, "by_part", lambda df, *cols: seen.append(df.count()) or inner(df, *cols))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(df, width=4).collect()) == brute_near(rows)
    confirming = seen[len(seen) // 2 :]
    assert max(confirming) < 3 * len(rows)  # pairs of all blocks would be 10 rows for each


def test_lone_bands_are_not_kept(spark, monkeypatch):
    draw, kept, settle = random.Random(3), [], near_dedup.settle

    def counted(df):
        out = settle(df)
        kept.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "settle", counted)
    texts = [" ".join(str(draw.randrange(10**6)) for _ in range(30)) for _ in range(50)]
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate([*texts, texts[7] + " x"])), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == {50}
    assert sum(n for columns, n in kept if {"band", "node"} <= columns) <= 3 * near_dedup.BANDS


def test_estimates_follow_similarity():
    draw = np.random.default_rng(3)
    for both, own, other in ((800, 100, 100), (500, 250, 250), (450, 50, 500), (60, 8, 7)):
        errors = []
        for _ in range(40):
            x = draw.integers(0, 1 << 63, both + own + other, dtype=np.uint64) * np.uint64(2)
            a, b = x[: both + own], np.r_[x[:both], x[both + own :]]
            errors.append(near_dedup.estimate(near_dedup.sketch(a), near_dedup.sketch(b)[None], len(a), np.array([len(b)]))[0] - both / len(x))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shingles_are_sets_of_words():
    assert len(shingles("a b c d e", 4)) == 2 and len(shingles("a b c d", 4)) == 1 == len(shingles("A", 4))
    assert len(shingles(" \t", 4)) == 0 == len(shingles(None, 4))
    assert (shingles("A  b\x0bC d e", 4) == shingles("a b c d e", 4)).all()
    assert (shingles("É b c d", 4) != shingles("é b c d", 4)).all() and (shingles("a\x1cb", 1) != shingles("a b", 2)).all()
    assert len(shingles("x y " * 50, 4)) == 2
