"""Searches, writers and streams on small fixtures."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import analysis
from spanloom.operators import mutation as M
from spanloom.operators import ranking as R
from spanloom.plans import query as Q
from spanloom.queries import QUERIES
from spanloom.schema import keyword, text
from spanloom.sources.index import Searcher, StoredIndex, TableIndex
from spanloom.streaming.ingest import SearcherManager
from tests.conftest import SF

FOXES = ["The quick brown fox jumps over a lazy dog", "The quick fox jumps over a lazy dog", "The fox jumps quick over a lazy dog"]


@pytest.fixture(scope="module")
def foxes(spark):
    return spark.createDataFrame([(k, x, "ab"[k % 2]) for k, x in enumerate(FOXES)], "doc_id long, title string, kind string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_phrases_by_slop(foxes):
    s = Searcher(TableIndex(foxes, "doc_id", ["title"]))
    assert [len(ids(s.hits(Q.Phrase("title", ("quick", "fox"), slop)))) for slop in range(4)] == [1, 2, 2, 3]


def test_stored_index_agrees(spark, foxes, tmp_path):
    source = TableIndex(foxes, "doc_id", [text("title"), keyword("kind")])
    here, stored = Searcher(source), Searcher(StoredIndex.write(source, str(tmp_path / "index")))
    trees = [Q.Term("title", "fox"), Q.Phrase("title", ("quick", "fox"), 2), Q.boolean([Q.Term("title", "quick")], [Q.Term("kind", "b")]), Q.boolean(must_nots=[Q.Term("kind", "a")]), Q.Term("title", "absent"), Q.SpanNear((Q.SpanTerm("title", "fox"), Q.SpanTerm("title", "over")), 4, True)]
    for q in trees:
        both = [{(r["doc_id"], round(r["score"], 9)) for r in s.hits(q).collect()} for s in (here, stored)]
        assert both[0] == both[1], str(q)
    assert stored.count(Q.Term("title", "fox")) == 3 == here.count(Q.ConstantScore(Q.MatchAll()))


def test_tokens(spark):
    rows = [("The quick  brown\n fox",), ("",), (None,), (" x y ",), ("é" * 300 + " z",)]
    out = spark.createDataFrame(rows, "t string").select(analysis.whitespace(F.col("t")).alias("w"), analysis.offsets(F.col("t")).alias("o")).collect()
    assert [r["w"] for r in out[:4]] == [["The", "quick", "brown", "fox"], [], [], ["x", "y"]]
    assert [(t["start"], t["end"]) for t in out[0]["o"]] == [(0, 3), (4, 9), (11, 16), (18, 21)]
    assert [len(w) for w in out[4]["w"]] == [256, 44, 1] and [t["start"] for t in out[4]["o"]] == [0, 256, 301]
    assert out[2]["o"] == []


def test_early_termination_and_explanation(spark, foxes):
    hits = spark.createDataFrame([(10 * s + d, s) for s in range(3) for d in (1, 5, 3, 4, 2)], "doc_id long, segment int")
    out = R.early_terminated(hits, "segment", 3).collect()
    assert len(out) == 9 and all(r["terminated"] for r in out)
    s = Searcher(TableIndex(foxes, "doc_id", ["title"]))
    q = Q.boolean([Q.Term("title", "fox")], [Q.Term("title", "brown")])
    made = R.explain(s, q, 0)
    score = {r["doc_id"]: r["score"] for r in s.hits(q).collect()}[0]
    assert made.matched and abs(made.value - score) < 1e-12 and abs(sum(d.value for d in made.details) - score) < 1e-12
    assert "docFreq=3" in str(made) and not R.explain(s, Q.Term("title", "none"), 0).matched


def test_writer_and_manager(spark, tmp_path):
    path, docs = str(tmp_path / "w"), lambda *rows: spark.createDataFrame(rows, "doc_id long, body string, n long")
    w = M.IndexWriter(spark, path, "doc_id", ["body"])
    with pytest.raises(FileNotFoundError):
        M.IndexWriter(spark, path, "doc_id", ["body"], mode="append")
    assert w.add_documents(docs((1, "a b", 1), (2, "b c", 2))) == 1 and w.has_uncommitted_changes()
    assert ids(w.reader().hits(Q.Term("body", "b"))) == [1, 2] and not M.exists(spark, path)
    w.delete_by_terms(("body", "c"))
    w.add_documents(docs((3, "c", 3)))  # after the delete, so it stays
    w.commit()
    manager = SearcherManager(spark, path, "doc_id", ["body"])
    heard = []
    manager.add_listener(lambda: heard.append("before"), heard.append)
    assert ids(manager.acquire().hits(Q.MatchAll())) == [1, 3]
    w.keep = 2
    w.update_documents(("body", "a"), docs((1, "a z", 9)))
    w.update_numeric(("body", "c"), "n", 7)
    assert w.commit() == 2 and not manager.is_current() and manager.maybe_refresh() and manager.is_current()
    assert heard == ["before", True]
    assert sorted(tuple(r) for r in M.read(spark, path).collect()) == [(1, "a z", 9), (3, "c", 7)]
    w.delete_by_queries(Q.MatchAll(), limit=1)
    w.rollback()
    again = M.IndexWriter(spark, path, "doc_id", ["body"], mode="append", keep=2)
    assert again.force_merge(1) == 3 and again.counts() == {"num_docs": 2, "version": 3}
    assert again.commit() == 3


def test_highlights_of_all_hits(spark):
    made = QUERIES["highlight"](spark, SF).collect()
    assert {r["doc_id"] for r in made} == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if "the" in (r["text"] or "").split()}
    assert len(made) > 20 and all("<b>" in r["marked"] for r in made)


def test_offsets_of_whole_texts(spark):
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want.update((r["doc_id"], m.group(), k, m.start(), m.end()) for k, m in enumerate(re.finditer(r"\S+", r["text"] or "")))
    assert max(pos for _, _, pos, _, _ in want) > 1000 and all(len(t.encode()) < analysis.MAX_TOKEN_BYTES for _, t, *_ in want)
    assert Counter(tuple(r) for r in QUERIES["token_offsets"](spark, SF).collect()) == want


def test_term_vectors_of_all_documents(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = (r["text"] or "").split()
        want |= {(r["doc_id"], w, n, words.index(w)) for w, n in Counter(words).items()}
    made = [tuple(r) for r in QUERIES["term_vectors"](spark, SF).collect()]
    assert len(made) == len(want) and set(made) == want
