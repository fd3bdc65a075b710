"""Hand-made fixtures of what needs them: spans, several values, sort keys, highlighting, changes, points, plans."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import analysis
from spanloom.functions.similarity import Similarity
from spanloom.operators import dictionary as D
from spanloom.operators import highlight as H
from spanloom.operators import mutation as M
from spanloom.operators import ranking as R
from spanloom.plans import query as Q
from spanloom.plans import spans
from spanloom.schema import keyword, text
from spanloom.sources.index import Searcher, StoredIndex, TableIndex
from spanloom.streaming.ingest import ingest


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.fixture(scope="module")
def letters(spark):
    """H1: span texts, drawn so that terms stand near each other in all ways."""
    draw = np.random.default_rng(4)
    rows = [(0, "a b c"), (1, "a x b c"), (2, "b a"), (3, "a b a b"), (4, "x y"), (5, ""), (6, None)]
    rows += [(k, " ".join(draw.choice(list("abcdx"), draw.integers(1, 30)))) for k in range(7, 150)]
    return spark.createDataFrame(rows, "doc_id long, body string").repartition(3)


class Plain(Similarity):
    def score(self, freq, length, field, terms, boost=1.0):
        return freq * boost


@pytest.mark.parametrize(
    "tree",
    [
        lambda s: s("a"),
        lambda s: Q.SpanOr((s("a"), s("b"), s("a"))),
        lambda s: Q.SpanNear((s("a"), s("b")), 2, True),
        lambda s: Q.SpanNear((s("a"), s("a")), 3, True),
        lambda s: Q.SpanNear((s("a"), s("b"), s("c")), 4, True),
        lambda s: Q.SpanNear((Q.SpanOr((s("a"), s("b"))), s("b"), s("a")), 6, True),
        lambda s: Q.SpanNear((s("a"), Q.SpanGap("body", 2), s("b"), Q.SpanGap("body", 1), s("c")), 3, True),
        lambda s: Q.SpanNear((s("a"), s("b")), 1, False),
        lambda s: Q.SpanNear((Q.SpanOr((s("a"), s("c"))), s("b")), 3, False),
    ],
)
def test_folded_spans_agree_with_cursors(letters, tree):
    query = tree(lambda t: Q.SpanTerm("body", t))
    searcher = Searcher(TableIndex(letters, "doc_id", ["body"]), Plain())
    made = {r["doc_id"]: r["score"] for r in searcher.hits(query).collect()}
    want = {}
    for r in letters.collect():
        words = (r["body"] or "").split()
        freq = spans.freq(query.spans({x: np.array([k for k, w in enumerate(words) if w == x[1]], "int64") for x in query.leaves()}))
        if freq:
            want[r["doc_id"]] = freq
    assert made.keys() == want.keys() and all(math.isclose(made[k], want[k]) for k in want) and len(want) > 20


def test_conditions_reach_the_scan(spark, tmp_path):
    rows = [(k, "a b", "en" if k % 2 else "de", k) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, body string, lang string, n long").write.parquet(str(tmp_path / "d"))
    searcher = Searcher(TableIndex(spark.read.parquet(str(tmp_path / "d")), "doc_id", [text("body"), keyword("lang")]))
    hits = searcher.hits(Q.boolean([Q.Term("body", "a")], filters=[Q.Term("lang", "en"), Q.point_range("n", 10, 19)]))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(lang,en)" in pushed and "GreaterThanOrEqual(n,10)" in pushed and "LessThanOrEqual(n,19)" in pushed
    assert ids(hits) == [11, 13, 15, 17, 19]
    among = searcher.hits(Q.Term("body", "a"), within=spark.createDataFrame([(3,), (500,)], "doc_id long"))
    assert ids(among) == [3] and among.first()["score"] == searcher.hits(Q.Term("body", "a")).where("doc_id = 3").first()["score"]


def test_points_at_their_limits(spark):
    """H6: bounds inclusive, signed zeros, infinities, NaN, least and greatest integers."""
    nan, inf, low, high = float("nan"), math.inf, -(1 << 63), (1 << 63) - 1
    rows = [(0, -0.0, low), (1, 0.0, high), (2, inf, 0), (3, -inf, None), (4, nan, 1), (5, 1.5, -1), (6, None, 5)]
    s = Searcher(TableIndex(spark.createDataFrame(rows, "doc_id long, d double, l long"), "doc_id", []))
    assert ids(s.hits(Q.point_range("d", 0.0, 1.5))) == [0, 1, 5]
    assert ids(s.hits(Q.point_range("d", -inf, inf))) == [0, 1, 2, 3, 5]
    assert ids(s.hits(Q.point_range("l", low, low))) == [0] and ids(s.hits(Q.point_range("l", 0, high))) == [1, 2, 4, 6]
    assert ids(s.hits(Q.Exists("d"))) == [0, 1, 2, 3, 4, 5]


def test_several_values(spark):
    """H2: null, none, one, several, repeated ones."""
    rows = [(0, None, None), (1, [], []), (2, ["x"], [1]), (3, ["x", "y"], [1, 9]), (4, ["y", "y", None], [5, 5])]
    index = TableIndex(spark.createDataFrame(rows, "doc_id long, tags array<string>, nums array<long>"), "doc_id", [keyword("tags")])
    s = Searcher(index)
    assert ids(s.hits(Q.Term("tags", "x"))) == [2, 3] and ids(s.hits(Q.Exists("tags"))) == [2, 3, 4]
    assert ids(s.hits(Q.point_range("nums", 4, 8))) == [4] and ids(s.hits(Q.point_range("nums", 1, 1))) == [2, 3]
    assert {(r["doc_id"], r["term"], r["tf"], tuple(r["positions"])) for r in index.postings().collect()} == {(2, "x", 1, (0,)), (3, "x", 1, (0,)), (3, "y", 1, (1,)), (4, "y", 2, (0, 1))}


def test_sorts_and_groups(spark):
    """H3: missing keys, ties, groups in order of their first hit."""
    rows = [(k, 1.0 * (k % 3), key, g) for k, (key, g) in enumerate([(None, "a"), (0, "a"), (-3, "b"), (7, "b"), (7, None), (2, None)])]
    hits = spark.createDataFrame(rows, "doc_id long, score double, k long, g string")
    assert [r["doc_id"] for r in R.top_sorted(hits, [R.SortKey("k", reverse=True)], 6).orderBy("rank").collect()] == [3, 4, 5, 1, 2, 0]
    assert [r["doc_id"] for r in R.top_sorted(hits, [R.SortKey("k", missing=3)], 4).orderBy("rank").collect()] == [2, 1, 5, 0]
    assert [r["doc_id"] for r in R.top_sorted(hits, [R.SortKey(F.abs("k") % 3)], 3).orderBy("rank").collect()] == [1, 2, 3]
    out = R.collapse_sorted(hits, "g", [R.SortKey("k", reverse=True)], 2).orderBy("rank").collect()
    assert [(r["collapse_value"], r["doc_id"], r["group_hits"], r["total_groups"]) for r in out] == [("b", 3, 2, 3), (None, 4, 2, 3)]
    assert {(r["collapse_value"], r["doc_id"]) for r in R.collapse(hits, "g").collect()} == {("a", 1), ("b", 2), (None, 5)}


def test_scores_by_parts(spark, letters):
    s = Searcher(TableIndex(letters, "doc_id", ["body"]))
    tree = Q.boolean([Q.Term("body", "a")], [Q.boosted(Q.Term("body", "b"), 3.0)])
    score = {r["doc_id"]: r["score"] for r in s.hits(tree).collect()}
    rows = R.explanations(s, tree).collect()
    assert {r["doc_id"]: r["value"] for r in rows if r["depth"] == 0} == score
    parts = {}
    for r in rows:
        parts.setdefault((r["doc_id"], r["node"]), {})[r["part"]] = r["value"]
    for own in parts.values():
        if "idf" in own:
            assert any(math.isclose(own["Term"], own["idf"] * own["tfNorm"] * b) for b in (1, 3))
    made = R.explain(s, tree, 3)
    assert math.isclose(made.value, score[3]) and "tfNorm, from freq=2" in str(made) and "boost" in str(made)


def test_collectors(spark, letters):
    s = Searcher(TableIndex(letters, "doc_id", ["body"]))
    with R.chained(s.hits(Q.Term("body", "a")), lambda h: h.count(), lambda h: h.agg(F.max("score")).first()[0]) as (n, most):
        assert n > 20 and most > 0
    cache = R.QueryCache(s, 1)
    first = cache.hits(Q.Term("body", "a"))
    assert cache.hits(Q.Term("body", "a")) is first and (cache.found, cache.missed) == (1, 1)
    cache.hits(Q.Term("body", "b"))
    assert len(cache.kept) == 1 and cache.hits(Q.Term("body", "a")) is not first
    cache.clear()
    assert len(R.timed(s.hits(Q.Term("body", "a")), 60)) == n

    @F.udf("long")
    def slow(x):
        time.sleep(5)
        return x

    with pytest.raises(TimeoutError):
        R.timed(spark.range(8).select(slow("id")), 1)


def test_rescoring_requests_and_features(spark, letters):
    s = Searcher(TableIndex(letters, "doc_id", ["body"]))
    top = s.top(Q.Term("body", "a"), 10)
    requests = [R.RescoreRequest(Q.Term("body", "b"), 5), R.RescoreRequest(Q.Term("body", "c"), 3, "max", 2.0)]
    one = R.rescore(s, top, Q.Term("body", "b"), 5)
    two = R.rescore(s, one, Q.Term("body", "c"), 3, "max", 2.0)
    assert R.rescore_all(s, top, requests).orderBy("rank").collect() == two.orderBy("rank").collect()
    made = {r["doc_id"]: r["features"] for r in R.feature_map(s, top, {"b": Q.Term("body", "b"), "none": Q.Term("body", "zz")}).collect()}
    assert made and all(set(f) == {"previous_score", "b"} for f in made.values())


def test_stored_segments(spark, letters, tmp_path):
    source = TableIndex(letters.where("doc_id % 2 = 0"), "doc_id", ["body"])
    stored = StoredIndex.write(source, str(tmp_path / "i")).append(letters.where("doc_id % 2 = 1"))
    tree = Q.boolean([Q.Term("body", "a")], [Q.Phrase("body", ("a", "b"), 2)])
    same = lambda i, docs: [{(r["doc_id"], round(r["score"], 9)) for r in s.hits(tree).collect()} for s in (Searcher(i), Searcher(TableIndex(docs, "doc_id", ["body"])))]
    a, b = same(stored, letters)
    assert a == b and len(stored.segments) == 2
    before = stored.version
    less = stored.delete(Q.Term("body", "d"))
    left = M.delete_by_query(TableIndex(letters, "doc_id", ["body"]), Q.Term("body", "d"))
    a, b = same(less, left)
    assert a == b and less.version == before + 1 and len(ids(Searcher(stored).hits(tree))) > len(a)  # an old version still reads as it was
    merged = less.merge()
    a, b = same(merged, left)
    assert a == b and len(merged.segments) == 1 and not merged.has_deletes
    again = merged.append(letters.where("doc_id = 3").withColumn("body", F.lit("d d d")))  # an id deleted before
    assert 3 in ids(Searcher(again).hits(Q.Term("body", "d")))


def test_inversion_by_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "t array<string>")
    out = [r["i"] for r in rows.select(analysis.inverted("t").alias("i")).collect()]
    assert [tuple(map(tuple, ((x["term"],), x["positions"]))) for x in out[0]] == [(("b",), (0, 2)), (("a",), (1,))] and out[1] == out[2] == []


def test_ordinals_of_segments(spark):
    parts = {"x": spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "y": spark.createDataFrame([("c",), ("b",)], "v string")}
    out = {(r["segment"], r["value"]): (r["local_ord"], r["ord"]) for r in D.ordinal_map(parts, "v").collect()}
    assert out == {("x", "a"): (0, 0), ("x", "b"): (1, 1), ("y", "b"): (0, 1), ("y", "c"): (1, 2)}


def test_best_windows_follow_their_definition():
    """H4: the run of matches of most weight that fits; of equal ones the first; a run of one only at the start."""
    draw = np.random.default_rng(7)
    for _ in range(400):
        at, found = 0, []
        for _ in range(draw.integers(1, 12)):
            at += int(draw.integers(1, 15))
            end = at + int(draw.integers(1, 6))
            found.append(H.Match(at, end, float(draw.integers(1, 5)), 0, [(at, end)]))
            at = end
        size = int(draw.integers(18, 60))
        runs = [(0, 0), *((i, j) for j in range(1, len(found)) for i in range(j) if found[j].end - found[i].start <= max(size - 6, 18))]
        best = max(sum(m.boost for m in found[i : j + 1]) for i, j in runs)
        want = next((i, j) for i, j in runs if sum(m.boost for m in found[i : j + 1]) == best)
        own = H.best_window(found, size)[0].matches
        assert sum(m.boost for m in own) == best and own[-1] is found[want[1]]


def test_streams_delete(spark, tmp_path):
    """H5: adds and deletes of one key in a batch and across batches; the last by sequence number counts."""
    path, log = str(tmp_path / "i"), str(tmp_path / "log")
    batch = lambda rows: spark.createDataFrame(rows, "seq_no long, op string, doc_id long, body string").coalesce(1).write.mode("append").parquet(log)
    changes = lambda: spark.readStream.schema("seq_no long, op string, doc_id long, body string").parquet(log)
    batch([(1, "add", 1, "a"), (2, "add", 2, "a"), (3, "delete", 1, None), (4, "add", 3, "a b")])
    ingest(changes(), path, "doc_id", ["body"], str(tmp_path / "c")).awaitTermination()
    assert ids(M.read(spark, path)) == [2, 3]
    batch([(5, "delete", 2, None), (6, "add", 3, "c"), (7, "add", 1, "a")])
    ingest(changes(), path, "doc_id", ["body"], str(tmp_path / "c")).awaitTermination()
    assert {(r["doc_id"], r["body"]) for r in M.read(spark, path).collect()} == {(1, "a"), (3, "c")}


def test_compaction_by_sequence(spark):
    docs = spark.createDataFrame([(1, 1), (1, 5), (2, 2)], "doc_id long, seq_no long")
    deletes = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, seq_no long")
    assert sorted(tuple(r) for r in M.compact(docs, deletes, "doc_id", 2).collect()) == [(1, 5), (2, 2)]
