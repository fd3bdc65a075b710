"""One query per operator, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import analysis, scalars
from spanloom.operators import dictionary as D
from spanloom.operators import highlight as H
from spanloom.operators import mutation as M
from spanloom.operators import ranking as R
from spanloom.plans import query as Q
from spanloom.plans.parser import parse
from spanloom.schema import keyword, text
from spanloom.sources.index import Searcher, TableIndex
from spanloom.sources.snapshots import new_folder
from spanloom.streaming.ingest import SearcherManager, ingest

Made = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Made] = {}


def query(f: Made) -> Made:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str) -> TableIndex:
    return TableIndex(table(spark, sf_dir, "documents"), "doc_id", [text("text"), keyword("lang"), keyword("source")])


def searcher(spark: SparkSession, sf_dir: str) -> Searcher:
    return Searcher(index(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def t(term: str, boost: float = 1.0) -> Q.Term:
    return Q.Term("text", term, boost)


def st(term: str) -> Q.SpanTerm:
    return Q.SpanTerm("text", term)


#: Query trees whose hits and scores are the result.
TREES: dict[str, Q.Query] = {
    "term_bm25": t("the"),
    "term_keyword": Q.Term("lang", "fr"),
    "bool_must_should": Q.boolean([t("the")], [t("and"), t("is")]),
    "bool_filter_only": Q.boolean(filters=[t("le")]),
    "bool_filter_must": Q.boolean([t("and")], filters=[Q.Term("lang", "en"), Q.point_range("n_chars", 1000, None)]),
    "bool_must_not_only": Q.boolean(must_nots=[t("the"), t("de")]),
    "bool_min_should_match": Q.boolean(shoulds=[t("the"), t("and"), t("of"), t("que")], min_should_match=3),
    "bool_nested": Q.boolean([Q.boolean(shoulds=[t("the"), t("le")])], [Q.boolean([t("and"), t("of")])], must_nots=[t("is"), t("qui")]),
    "dismax": Q.disjunction_max([t("the"), t("and"), t("le")], 0.3),
    "boosting": Q.Boosting(t("the"), t("is"), 0.25),
    "boost_nested": Q.boosted(Q.boolean([t("the"), Q.boosted(t("and"), 3.0)], [Q.boosted(Q.MatchAll(), 0.5)]), 2.0),
    "constant_score": Q.ConstantScore(Q.boolean(shoulds=[t("the"), t("de")]), 1.5),
    "match_all": Q.MatchAll(),
    "phrase_exact": Q.Phrase("text", ("of", "the")),
    "phrase_gap_positions": Q.Phrase("text", ("the", "and"), 0, (0, 2)),
    "phrase_repeated_term": Q.Phrase("text", ("the", "of", "the"), 0, (0, 1, 3)),
    "phrase_sloppy_scored": Q.Phrase("text", ("the", "of"), 3),
    "phrase_sloppy_three": Q.Phrase("text", ("the", "of", "and"), 6),
    "span_term": st("and"),
    "span_near_ordered": Q.SpanNear((st("the"), st("of")), 3, True),
    "span_near_ordered_three": Q.SpanNear((st("the"), st("of"), st("and")), 10, True),
    "span_near_unordered": Q.SpanNear((st("the"), st("is")), 2, False),
    "span_near_unordered_three": Q.SpanNear((st("the"), st("is"), st("and")), 6, False),
    "span_or": Q.SpanOr((st("is"), st("was"))),
    "span_near_or": Q.SpanNear((Q.SpanOr((st("is"), st("was"))), st("the")), 2, True),
    "span_gap": Q.SpanNearBuilder("text", True).add_clause(st("the")).add_gap(1).add_clause(st("and")).with_slop(0).build(),
    "span_boost": Q.SpanBoost(Q.SpanNear((st("and"), st("the")), 1, True), 2.5),
    "point_int_range": Q.point_range("n_chars", 1000, 2000),
    "point_boosted": Q.boosted(Q.point_range("n_chars", None, 500), 4.0),
    "query_string": parse("+the and^2 (of is)", [("text", 1.0)]),
    "query_string_multifield": parse("fr +(le^2 de)", [("text", 1.0), ("lang", 2.0)]),
    "query_string_quoted": parse('"the"^0.5 +of', [("text", 1.0)]),
    "query_string_phrase": parse('"of the~0" +and', [("text", 2.0)]),
}


def _tree(name: str, tree: Q.Query) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(searcher(spark, sf_dir).hits(tree))

    run.__name__ = name
    query(run)


for _name, _q in TREES.items():
    _tree(_name, _q)


@query
def top_k(spark, sf_dir):
    return rounded(searcher(spark, sf_dir).top(Q.boolean([t("the")], [t("and"), t("is")]), 10))


@query
def term_count(spark, sf_dir):
    return searcher(spark, sf_dir).hits(t("the"), scoring=False).agg(F.count("*").alias("hits"))


@query
def phrase_sloppy2(spark, sf_dir):
    return searcher(spark, sf_dir).hits(Q.Phrase("text", ("the", "of"), 2), scoring=False).select("doc_id")


def _points(spark, sf_dir, name, key, q):
    return Searcher(TableIndex(table(spark, sf_dir, name), key, [])).hits(q).select(F.col("doc_id").alias(key))


@query
def point_double_range(spark, sf_dir):
    return _points(spark, sf_dir, "customer", "c_custkey", Q.point_range("c_acctbal", -500.0, 1000.0))


@query
def point_exclusive_range(spark, sf_dir):
    return _points(spark, sf_dir, "events", "event_id", Q.point_range("value", scalars.next_up(10.0), scalars.next_down(20.0)))


@query
def point_long_exact(spark, sf_dir):
    return _points(spark, sf_dir, "orders", "o_orderkey", Q.boolean(shoulds=[Q.point_exact("o_custkey", 7), Q.point_exact("o_custkey", 11)]))


@query
def point_2d_box(spark, sf_dir):
    index = TableIndex(table(spark, sf_dir, "lineitem"), "l_orderkey", [])
    return Searcher(index).hits(Q.point_box(("l_quantity", "l_discount"), (5.0, 0.02), (10.0, 0.05)), "l_linenumber").select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@query
def point_multivalued(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return Searcher(TableIndex(orders, "l_orderkey", [])).hits(Q.point_range("q", 49.5, 60.0)).select(F.col("doc_id").alias("l_orderkey"))


def _labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return TableIndex(table(spark, sf_dir, "documents").join(labels, "doc_id", "left"), "doc_id", [text("text"), keyword("source")])


@query
def exists_dv(spark, sf_dir):
    return rounded(Searcher(_labelled(spark, sf_dir)).hits(Q.boolean([t("the")], filters=[Q.Exists("quality")])))


@query
def filter_expression(spark, sf_dir):
    return rounded(searcher(spark, sf_dir).hits(Q.Filter(t("the"), (lambda col: col("n_chars") % 2 == 0,))))


@query
def filter_udf(spark, sf_dir):
    @F.pandas_udf("boolean")
    def third(n: pd.Series) -> pd.Series:
        return n % 3 == 0

    return rounded(searcher(spark, sf_dir).hits(Q.Filter(t("the"), (lambda col: third(col("n_chars")),))))


@query
def min_score(spark, sf_dir):
    return rounded(R.min_score(searcher(spark, sf_dir).hits(t("is")), 0.5))


@query
def early_terminate(spark, sf_dir):
    hits = searcher(spark, sf_dir).hits(t("the"), "source", scoring=False)
    return R.early_terminated(hits, "source", 3).select("source", "doc_id", "terminated")


@query
def sort_numeric_missing(spark, sf_dir):
    hits = Searcher(_labelled(spark, sf_dir)).hits(t("and"), "quality", "n_chars", scoring=False)
    return R.top_sorted(hits, [R.SortKey("quality", reverse=True, missing=-1), R.SortKey("n_chars")], 25).select("rank", "doc_id", "quality", "n_chars")


@query
def sort_string(spark, sf_dir):
    hits = searcher(spark, sf_dir).hits(t("and"), "source")
    return rounded(R.top_sorted(hits, [R.SortKey("source"), R.SortKey("score", reverse=True)], 20)).select("rank", "doc_id", "source")


@query
def sort_sorted_numeric_min(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("prices"))
    hits = Searcher(TableIndex(orders, "l_orderkey", [])).hits(Q.MatchAll(), "prices")
    return R.top_sorted(hits, [R.SortKey("prices", selector="min")], 15).select("rank", F.col("doc_id").alias("l_orderkey"), F.array_min("prices").alias("least"))


@query
def collapse(spark, sf_dir):
    hits = searcher(spark, sf_dir).hits(t("the"), "source")
    return rounded(R.collapse(hits, "source")).withColumnRenamed("collapse_value", "source")


def _first(spark, sf_dir, k=20):
    s = searcher(spark, sf_dir)
    return s, s.top(t("the"), k)


def _rescored(mode: str, window: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, top = _first(spark, sf_dir)
        return rounded(R.rescore(s, top, t("is"), window, mode, 0.5, 2.0))

    run.__name__ = f"rescore_{mode}"
    query(run)


for _mode in R.MODES:
    _rescored(_mode, 12)


@query
def rescore_model(spark, sf_dir):
    @F.pandas_udf("double")
    def model(n: pd.Series) -> pd.Series:
        return n / 1000.0

    s, top = _first(spark, sf_dir)
    features = s.index.docs.select("doc_id", "n_chars")
    return rounded(R.rescore_with(top, features, 12, model, ["n_chars"]))


@query
def rescore_features(spark, sf_dir):
    s, top = _first(spark, sf_dir)
    return R.rescore_features(s, top, t("is")).select("doc_id", F.round("previous_score", 6).alias("previous_score"), F.round("feature_score", 6).alias("feature_score"))


@query
def facets(spark, sf_dir):
    return searcher(spark, sf_dir).hits(t("the"), "lang", "n_chars", scoring=False).groupBy("lang").agg(F.count("*").alias("hits"), F.sum("n_chars").alias("chars"))


@query
def inverted_index(spark, sf_dir):
    return index(spark, sf_dir).postings(["text"]).select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"), "len")


@query
def term_dict_stats(spark, sf_dir):
    return index(spark, sf_dir).term_counts(["text"]).select("term", "df", "ttf")


@query
def dictionary_stats(spark, sf_dir):
    i, names = index(spark, sf_dir), ["text", "lang", "source"]
    lengths = [i.lengths(n).select(F.lit(n).alias("field"), "doc_id", "len") for n in names]
    return D.dictionary_stats(i.term_counts(names), reduce(DataFrame.unionByName, lengths))


@query
def term_seek_ceil(spark, sf_dir):
    terms = index(spark, sf_dir).term_counts(["text", "lang"])
    return D.seek_ceiling(terms, "text", "thf").unionByName(D.seek_ceiling(terms, "lang", "fr")).unionByName(D.seek_ceiling(terms, "lang", "zz"))


@query
def term_prefix(spark, sf_dir):
    terms = index(spark, sf_dir).term_counts(["text"])
    return D.filtered_terms(terms, lambda c: c.startswith("tha")).select("term", "df")


@query
def field_stats(spark, sf_dir):
    i = index(spark, sf_dir)
    return D.field_stats(i.lengths("text"), i.docs.count()).withColumn("avg_length", F.round("avg_length", 6))


@query
def point_stats(spark, sf_dir):
    return D.point_stats(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")


@query
def dv_ordinals(spark, sf_dir):
    return D.ordinals(table(spark, sf_dir, "nation"), "n_name")


@query
def norms(spark, sf_dir):
    return D.norms(index(spark, sf_dir).lengths("text")).withColumn("dl", F.round("dl", 6))


@query
def term_vectors(spark, sf_dir):
    return index(spark, sf_dir).postings(["text"]).select("doc_id", "term", "tf", F.element_at("positions", 1).alias("first_pos"))


@query
def stored_fields(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return D.stored(s.index.docs, s.hits(t("qui"), scoring=False), "doc_id", ["source", "n_chars"])


@query
def token_offsets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(analysis.offsets(F.col("text"))).alias("x")).select("doc_id", "x.term", "x.pos", "x.start", "x.end")


@query
def sorted_set_dv(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    kinds = scalars.sorted_set(F.col("types"))
    return events.select("user_id", F.array_join(kinds, ",").alias("kinds"), scalars.select(kinds, "middle_min").alias("middle"))


@query
def doc_set_algebra(spark, sf_dir):
    s = searcher(spark, sf_dir)
    one, two, three = (s.hits(t(x), scoring=False).select("doc_id") for x in ("the", "is", "de"))
    return D.difference(D.intersection(one, two), three).withColumn("kind", F.lit("and_not")).unionByName(D.union(two, three).withColumn("kind", F.lit("or")))


@query
def required_optional(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return rounded(D.required_and_optional(s.hits(t("the")), s.hits(t("is"))))


@query
def delete_by_term(spark, sf_dir):
    return M.delete_by_terms(index(spark, sf_dir), ("text", "the"), ("lang", "de")).select("doc_id", "lang")


@query
def delete_by_query(spark, sf_dir):
    return M.delete_by_query(index(spark, sf_dir), Q.boolean([t("the")], filters=[Q.point_range("n_chars", 2000, None)])).select("doc_id", "n_chars")


@query
def update_document(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("source = 'src1'").withColumns({"n_chars": F.lit(0).cast("long"), "lang": F.lit("xx")})
    return M.update(index(spark, sf_dir), ("source", "src1"), new).select("doc_id", "lang", "n_chars", "source")


@query
def update_numeric_dv(spark, sf_dir):
    return M.update_numeric(index(spark, sf_dir), t("the"), "n_chars", -1).select("doc_id", "n_chars")


@query
def last_update_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "value", F.col("event_id").alias("seq_no"))
    return M.last_updates(events, table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal").select("c_custkey", "c_acctbal")


@query
def change_log_latest(spark, sf_dir):
    return M.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query
def index_sort(spark, sf_dir):
    sorted_ = M.index_sorted(table(spark, sf_dir, "orders"), 4, "o_totalprice", "o_orderkey").withColumn("segment", F.spark_partition_id())
    return sorted_.select("o_orderkey", "o_totalprice")


@query
def compaction(spark, sf_dir):
    deletes = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return M.compact(table(spark, sf_dir, "documents"), deletes, "doc_id", 2, ["doc_id"]).select("doc_id", "source", "n_chars")


@query
def highlight(spark, sf_dir):
    i = index(spark, sf_dir)
    q = Q.boolean([t("the")], [t("of"), t("and")])
    return H.highlight(i, q, Searcher(i).hits(q), "text", 100, number=2, builder="windows", encoder="html").select("doc_id", F.array_join("fragments", " ... ").alias("marked"))


@query
def nrt_stream(spark, sf_dir):
    """Orders arrive as a stream of changes; the newest state of each customer is searched after a refresh."""
    folder = new_folder(spark)
    orders = table(spark, sf_dir, "orders")
    log = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq_no"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("add").alias("op"), F.col("o_orderpriority").alias("text"), "o_totalprice")
    log.write.parquet(f"{folder}/log")
    changes = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
    ingest(changes, f"{folder}/index", "doc_id", ["text"], f"{folder}/progress").awaitTermination()
    manager = SearcherManager(spark, f"{folder}/index", "doc_id", ["text"])
    return manager.acquire().hits(t("1-URGENT"), "o_totalprice").select("doc_id", "o_totalprice")
