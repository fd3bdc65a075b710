"""What keeps time and memory in bounds on large tables."""

import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.functions import analysis
from spanloom.operators import highlight as H
from spanloom.operators import mutation as M
from spanloom.plans import query as Q
from spanloom.queries import QUERIES
from spanloom.schema import keyword, text
from spanloom.sources import index, snapshots
from spanloom.sources.index import StoredIndex, TableIndex
from tests.conftest import SF


def test_segments_keep_nothing_in_between(spark, tmp_path, monkeypatch):
    """Postings are neither kept while a segment is written nor sorted by a column that is the same in all rows."""
    rows = [(k, " ".join("abcde"[j % 5] for j in range(k % 9)), "xy"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, `a=b` string").repartition(3)
    fields = [text("body"), keyword("a=b")]
    monkeypatch.setattr(type(docs), "persist", lambda *a: pytest.fail("postings were kept"))
    stored = StoredIndex.write(TableIndex(docs.where("doc_id < 100"), "doc_id", fields), str(tmp_path / "i")).append(docs.where("doc_id >= 100"))
    merged = stored.delete(Q.Term("a=b", "x")).merge()
    for made, left in ((stored, docs), (merged, docs.where("`a=b` = 'y'"))):
        source = TableIndex(left, "doc_id", fields)
        for part in ("term_counts", "postings"):
            own, want = ([tuple(map(str, r)) for r in getattr(i, part)().collect()] for i in (made, source))
            assert sorted(own) == sorted(want), part
        lengths = [sorted(map(tuple, i.lengths("body").collect())) for i in (made, source)]
        assert lengths[0] == lengths[1] and len(lengths[0]) > 80


def test_inversion_takes_slices():
    """A batch, however long, is inverted and given back a slice at a time."""
    draw = random.Random(3)
    lists = [[f"w{draw.randrange(50)}" for _ in range(draw.choice([0, 5, 400]))] for _ in range(4000)] + [None, ["big"] * (analysis.SLICE_TOKENS + 5)]
    made = list(analysis.inverted.func(iter([pa.array(lists, pa.list_(pa.string()))])))
    assert len(made) > 3 and sum(map(len, made)) == len(lists)
    at = 0
    for piece in made:
        own = lists[at : at + len(piece)]
        assert len(piece) == 1 or sum(len(x or ()) for x in own) <= analysis.SLICE_TOKENS
        for row, got in zip(own, piece.to_pylist()):
            want: dict = {}
            for k, w in enumerate(row or ()):
                want.setdefault(w, []).append(k)
            assert {x["term"]: x["positions"] for x in got} == want
            assert all(x["tf"] == len(x["positions"]) for x in got) and len(got) == len(want)
        at += len(piece)


def test_words_of_a_long_text(spark):
    """Each word is compared with its neighbour: 60,000 took minutes when each was compared with all."""
    rows = [(0, [("b", 2, 1), ("a", 0, 1), ("b", 2, 1), ("a", 2, 1), ("x" * 200, 0, 200)]), (1, []), (2, None), (3, [("c", 0, 1), ("c", 0, 1)])]
    words = spark.createDataFrame(rows, "id int, w array<struct<value:string,begin:int,length:int>>").select("id", analysis.words(F.col("w")).alias("t"))
    assert {r["id"]: r["t"] for r in words.collect()} == {0: ["a", "x" * 128, "a", "b"], 1: [], 2: None, 3: ["c"]}
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: F.struct(k.cast("string").alias("value"), k.alias("begin"), F.lit(1).alias("length"))).alias("w"))
    began = time.time()
    assert long.select(F.size(analysis.words(F.col("w")))).first()[0] == 60_000 and time.time() - began < 20


def test_offsets_take_slices():
    """Texts are cut at the places of their bytes, a slice at a time, and as one by one."""
    draw = random.Random(5)
    spaces, letters = [s.decode() for s in analysis.SPACES], ["a", "é", "中", "😀", "\x1c", "\u200b", "xyz"]
    texts = [None, "", " ", "x" * 3000, *("".join(draw.choice(spaces if draw.random() < 0.3 else letters) for _ in range(draw.randrange(60))) for _ in range(2000)), "a b " * (analysis.SLICE_BYTES // 3), "last one"]
    made = list(analysis.offsets.func(iter([pa.array(texts, pa.string())])))
    assert len(made) > 2 and [x for m in made for x in m.to_pylist()] == analysis._offsets_by_row(pa.array(texts, pa.string())).to_pylist()
    assert max(len(m.values) for m in made) < analysis.SLICE_BYTES
    sliced = pa.array(texts, pa.string()).slice(5, 900)
    assert analysis._offsets(sliced).to_pylist() == analysis._offsets_by_row(sliced).to_pylist()


def test_highlights_are_made_in_slices(spark, monkeypatch):
    """A batch of texts is marked and given back a slice at a time."""
    made = []
    monkeypatch.setattr(H.F, "arrow_udf", lambda kind: lambda f: made.append(f) or F.pandas_udf(lambda x: x["0"], "string"), raising=False)
    docs = spark.createDataFrame([(0, "the cat")], "doc_id long, body string")
    H.highlight(TableIndex(docs, "doc_id", ["body"]), Q.Term("body", "the"), docs.select("doc_id"), "body", builder="single")
    texts = [None, "the end", *["of the " + "x " * 5000] * 1000]
    batch = pa.StructArray.from_arrays([pa.array(texts, pa.string())], ["0"])
    pieces = list(made[0](iter([batch])))
    assert len(pieces) > 5 and sum(map(len, pieces)) == len(texts) and max(p.nbytes for p in pieces) < 4 * analysis.SLICE_BYTES
    assert [x for p in pieces for x in p.to_pylist()][:3] == [[], ["<b>the</b> end"], ["of <b>the</b> " + "x " * 5000]]


def test_files_are_joined_by_row_group(spark, tmp_path):
    """What many tasks wrote goes into few files as it is; no single task reads it all."""
    path = str(tmp_path / "w")
    w = M.IndexWriter(spark, path, "doc_id", ["body"])
    w.add_documents(spark.range(0, 400, 1, 5).selectExpr("id AS doc_id", "concat('a ', id) AS body", "id % 7 AS n"))
    w.commit()
    for files in (2, 1, 7):
        w.force_merge(files)
        docs = snapshots.read(spark, path)
        left = [f for f in os.listdir(f"{path}/snapshot-{w.version}") if f.endswith(".parquet")]
        assert len(left) == files == len(docs.inputFiles()) and [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")] == []
        if files < 7:
            assert sum(pq.ParquetFile(f"{path}/snapshot-{w.version}/{f}").metadata.num_row_groups for f in left) > files
        assert sorted(map(tuple, docs.collect())) == [(k, f"a {k}", k % 7) for k in range(400)]
        assert sorted(r["doc_id"] for r in docs.where("doc_id between 100 and 102").collect()) == [100, 101, 102]


def test_dictionary_statistics_invert_once(spark):
    """Documents are counted by their lengths, not by a second inversion and a set of (field, id)."""
    made = QUERIES["dictionary_stats"](spark, SF)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("inverted(") + plan.count("inverted_text(") == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = [w for r in docs for w in (r["text"] or "").split()]
    text_ = next(r for r in made.collect() if r["field"] == "text")
    assert (text_["size"], text_["sum_ttf"], text_["doc_count"]) == (len(set(words)), len(words), sum(bool((r["text"] or "").split()) for r in docs))


def test_deleted_ids_go_to_the_postings(spark, tmp_path, monkeypatch):
    """Few deleted ids are sent, whatever the session's threshold is; more are joined by a shuffle. Both leave the same."""
    docs = spark.createDataFrame([(k, "a b" if k % 3 else "a") for k in range(60)], "doc_id long, body string")
    less = StoredIndex.write(TableIndex(docs, "doc_id", ["body"]), str(tmp_path / "i")).delete(Q.Term("body", "b"))
    monkeypatch.setattr(index, "SENT_IDS", 39)
    many = StoredIndex(spark, less.path, "doc_id", less.schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled = many.postings()
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(index, "SENT_IDS", 40)
        sent = less.postings()
        assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, sent.collect())) == sorted(map(str, shuffled.collect())) and sent.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_inverted_as_their_tokens(spark):
    """From bytes as from the tokens that column expressions make, cut ones included."""
    draw = random.Random(9)
    spaces = [s.decode() for s in analysis.SPACES] + ["\x1c", "\u200b", "\u180e"]
    texts = [None, "", " ", "é" * 300 + " z", "x" * 511, "x" * 510, *("".join(draw.choice([*spaces, "a", "b", "é", "中", "😀"]) for _ in range(draw.randrange(40))) for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    rows = docs.select("doc_id", analysis.inverted_text("body").alias("made"), analysis.inverted(analysis.whitespace(F.col("body"))).alias("want"), F.size(analysis.whitespace(F.col("body"))).alias("size")).collect()
    assert len(rows) == len(texts) and sum(len(r["made"]) for r in rows) > 4000
    for r in rows:
        assert sorted(map(tuple, r["made"])) == sorted(map(tuple, r["want"])), r["doc_id"]
        assert all(x["len"] == r["size"] for x in r["made"])
