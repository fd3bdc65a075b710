"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import time

from pyspark.sql import SparkSession

from spanloom.queries import QUERIES, TREES, t
from spanloom.plans import query as Q
from spanloom.sources.index import Searcher, StoredIndex, TableIndex
from spanloom.sources.snapshots import new_folder

HEADLINES = ("term_bm25", "bool_must_should", "dismax", "phrase_exact", "phrase_sloppy_scored", "span_near_ordered", "point_int_range", "query_string", "top_k", "collapse", "rescore_total", "term_dict_stats", "update_numeric_dv", "highlight")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "256k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(QUERIES["term_bm25"](spark, sf))  # starts the session's workers
    times: dict[str, float] = {}

    def timed(name: str, f) -> object:
        start = time.time()
        out = f()
        times[name] = round(time.time() - start, 3)
        return out

    for name in HEADLINES:
        timed(name, lambda: run(QUERIES[name](spark, sf)))  # noqa: B023
    folder = new_folder(spark)
    try:
        docs = TableIndex(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", ["text"])
        stored = Searcher(timed("index_build", lambda: StoredIndex.write(docs, f"{folder}/index")))
        timed("stored_top_k", lambda: stored.top(Q.boolean([t("the")], [t("and"), t("is")]), 10).collect())
        timed("stored_phrase", lambda: stored.top(Q.Phrase("text", ("of", "the")), 10).collect())
        timed("stored_count", lambda: stored.count(t("the")))
        timed("stored_dismax", lambda: run(stored.hits(TREES["dismax"])))
        timed("stored_span_near", lambda: run(stored.hits(TREES["span_near_ordered"])))
        timed("stored_sloppy", lambda: run(stored.hits(TREES["phrase_sloppy_scored"])))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "search_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
