"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

The first pass marks the filter slots that any row's hash reaches and the second keeps those reached at least
twice; as both are counts by slot, they come out of one aggregation. A row whose slots were not all reached twice
cannot have a copy: it passes straight through. Only the others are shuffled, by hash.

Cases: null text counts as the empty text, so nulls and empty texts are one group. A null id is smaller than any
other; a group of null ids only has a null keep_id and keeps one row. Of repeated rows (same id and text) exactly
one is marked kept. An empty table gives an empty result. Only the id and text columns are read by the report;
other columns, whatever their names, are carried by `drop_copies` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bloom import MAX_SLOTS, flagged, repeat_filter
from spanloom.llm.common import fresh, settle


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, in lower-case hex; null as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per row of df: id, keep_id (largest id of the group), group_size, kept, text_sha256."""
    rows = settle(df.select(F.col(id_col).alias("id"), F.unhex(digest(F.col(text_col))).alias("hash")))
    bits, pages = repeat_filter(rows, "hash", slots_per_row, max_slots)
    marked = settle(flagged(rows, "hash", settle(bits), pages, "maybe"))
    alone = marked.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "hash")
    # Both sides of the join are settled, so that adaptive joins can split a hash that many ids share.
    same = settle(marked.where("maybe").groupBy("hash", "id").agg(F.count("*").alias("copies")))
    groups = settle(same.groupBy("hash").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    dealt = same.join(groups, "hash").select("*", copy.alias("copy")).select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "hash")
    return alone.unionByName(dealt).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("hash")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, max_slots: int = MAX_SLOTS) -> DataFrame:
    """df with one row of each group of equal texts: that with the largest id. All columns stay."""
    hash_col, flag = fresh(df, "hash", "maybe")
    hashes = settle(df.select(F.unhex(digest(F.col(text_col))).alias(hash_col)))
    bits, pages = repeat_filter(hashes, hash_col, slots_per_row, max_slots)
    marked = flagged(df.withColumn(hash_col, F.unhex(digest(F.col(text_col)))), hash_col, settle(bits), pages, flag)
    row, order = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.col(id_col).isNotNull(), F.col(id_col))
    kept = marked.where(F.col(flag)).groupBy(hash_col).agg(F.max_by(row, order).alias(flag)).select(f"{flag}.*")
    return marked.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(kept)
