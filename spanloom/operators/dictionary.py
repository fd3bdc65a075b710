"""Scans of the term dictionary, postings, doc values, points and norms, and algebra on sets of documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.similarity import quantised_length


def term_stats(postings: DataFrame) -> DataFrame:
    """field, term, df, ttf."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def dictionary_stats(terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per field: size, sum_ttf, sum_df, doc_count, min_term, max_term; from (field, term, df, ttf) and (field, doc_id,
    len) of the documents that have the field."""
    per_term = terms.groupBy("field").agg(F.count("*").alias("size"), F.sum("ttf").alias("sum_ttf"), F.sum("df").alias("sum_df"), F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return per_term.join(lengths.groupBy("field").agg(F.count("*").alias("doc_count")), "field")


def field_stats(lengths: DataFrame, max_doc: Column | int) -> DataFrame:
    """max_doc, doc_count, sum_ttf, avg_length from (doc_id, len)."""
    return lengths.agg(F.lit(max_doc).cast("long").alias("max_doc"), F.count("*").alias("doc_count"), F.sum("len").alias("sum_ttf")).withColumn("avg_length", F.col("sum_ttf") / F.col("doc_count"))


def seek_exact(postings: DataFrame, field: str, term: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == term))


def seek_ceiling(terms: DataFrame, field: str, term: str) -> DataFrame:
    """asked, found (the least term from the asked one up; null at the end), status."""
    found = terms.where((F.col("field") == field) & (F.col("term") >= term)).agg(F.min("term").alias("found"))
    return found.select(F.lit(term).alias("asked"), "found", F.when(F.col("found").isNull(), "end").when(F.col("found") == term, "found").otherwise("not_found").alias("status"))


def seek_floor(terms: DataFrame, field: str, term: str) -> DataFrame:
    return terms.where((F.col("field") == field) & (F.col("term") <= term)).agg(F.max("term").alias("found"))


def filtered_terms(terms: DataFrame, accept: Callable[[Column], Column]) -> DataFrame:
    """Terms a predicate accepts: prefixes, ranges, patterns."""
    return terms.where(accept(F.col("term")))


def ordinals(values: DataFrame, col: str) -> DataFrame:
    """value, ord: distinct values in byte order, numbered from 0.

    Ranges of values are numbered in tasks of their own; offsets come from the ranges' sizes.
    """
    distinct = values.select(F.col(col).alias("value")).where("value is not null").distinct()
    parts = distinct.repartitionByRange("value").withColumn("__part", F.spark_partition_id())
    local = parts.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy("value")) - 1)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per partition
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__start"))
    return local.join(F.broadcast(starts), "__part").select("value", (F.col("__start") + F.col("__local")).cast("long").alias("ord"))


def ordinal_map(segments: Mapping[str, DataFrame], col: str) -> DataFrame:
    """segment, local_ord, value, ord: each segment's own ordinals, and those over all segments."""
    own = [ordinals(df, col).select(F.lit(name).alias("segment"), F.col("ord").alias("local_ord"), "value") for name, df in segments.items()]
    each = reduce(DataFrame.unionByName, own)
    return each.join(ordinals(reduce(DataFrame.unionByName, [df.select(col) for df in segments.values()]), col), "value")


def lookup_ordinal(numbered: DataFrame, n: int) -> DataFrame:
    return numbered.where(F.col("ord") == n)


def norms(lengths: DataFrame) -> DataFrame:
    """doc_id, len, dl: lengths as relevance sees them."""
    return lengths.select("doc_id", "len", quantised_length(F.col("len")).alias("dl"))


def term_vector(postings: DataFrame, doc_id: int) -> DataFrame:
    """field, term, tf, positions of one document, in order of terms."""
    return postings.where(F.col("doc_id") == doc_id).select("field", "term", "tf", "positions").orderBy("field", "term")


def lookup(postings: DataFrame, field: str, term: str, *columns: str) -> DataFrame:
    """A term's postings with the arrays asked for only."""
    return seek_exact(postings, field, term).select("doc_id", *columns)


def stored(docs: DataFrame, hits: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Stored fields of hits."""
    return docs.join(hits.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(F.col(id_col).alias("doc_id"), *columns)


def point_stats(docs: DataFrame, col: str, id_col: str) -> DataFrame:
    """size, doc_count, min_value, max_value of a point field, multi-valued or not."""
    kind = docs.schema[col].dataType.typeName()
    values = docs.select(F.col(id_col).alias("id"), (F.explode(col) if kind == "array" else F.col(col)).alias("v")).where("v is not null")
    if kind != "array":
        return values.agg(F.count("*").alias("size"), F.count("*").alias("doc_count"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))
    per = values.groupBy("id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.count("*").alias("doc_count"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))


def relation(cell_min: float, cell_max: float, lower: float, upper: float) -> str:
    """How a cell of values lies to a range: inside, outside or across."""
    if cell_max < lower or cell_min > upper:
        return "outside"
    return "inside" if lower <= cell_min and cell_max <= upper else "crosses"


# Sets of documents: DataFrames with doc_id.


def intersection(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [s.select("doc_id") for s in sets]).distinct()


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("doc_id") for s in sets]).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").join(b.select("doc_id"), "doc_id", "left_anti").distinct()


def required_and_optional(required: DataFrame, optional: DataFrame) -> DataFrame:
    """Required hits; those that are optional hits too score both."""
    return required.join(optional.select("doc_id", F.col("score").alias("__more")), "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("__more", F.lit(0.0))).alias("score"))
