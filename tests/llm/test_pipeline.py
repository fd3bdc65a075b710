"""Each stage on what the one before kept, against brute force."""

import hashlib
from collections import Counter

import corpus_pipeline
from spanloom.llm import language_id, mixing
from spanloom.llm.common import settle
from tests.llm.test_copies import brute_near
from tests.llm.test_rows import check_mix, check_packs


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], "/root/testdata/sf0.01").transform(settle))
    assert all(k.columns == columns for k in kept[:-1])
    start, named, exact, near, mixed, packed = [k.collect() for k in kept]

    lost = {r["doc_id"] for r in language_id.identify(docs).collect() if r["lang_pred"] == "und"}
    assert {r["doc_id"] for r in named} == {r["doc_id"] for r in start} - lost

    largest = {}
    for r in named:
        digest = hashlib.sha256(r["text"].encode()).digest()
        largest[digest] = max(largest.get(digest, -1), r["doc_id"])
    assert Counter(r["doc_id"] for r in exact) == Counter(largest.values())

    found = brute_near([(r["doc_id"], r["text"]) for r in exact], width=5)
    assert Counter(r["doc_id"] for r in near) == Counter(i for i, _, _, stays in found if stays)
    assert len(near) < len(exact) < len(named)

    plan = mixing.plan_mix(kept[3]).collect()
    check_mix(near, plan)
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in plan if r["taken"]}
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)

    check_packs([(r["doc_id"], r["text"]) for r in mixed], packed)


def test_stages_odd(spark, odd, nothing):
    for docs in (odd, nothing):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "").transform(settle)
            assert n == len(corpus_pipeline.STAGES) - 1 or out.columns == odd.columns
            docs = out
        assert docs.count() >= bool(docs is not nothing and out.count())


def test_runs_agree(spark, tmp_path):
    """The same rows, whatever the partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = []
    for n in (1, 5):
        docs.repartition(n).write.parquet(str(tmp_path / str(n) / "documents.parquet"))
        made.append(Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path / str(n))).collect()))
    assert made[0] == made[1] and len(made[0]) > 50
