"""Bloom filters as tables of bitmap pages, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, next_power, settle

#: Slots of one page of the filter: what `bitmap_construct_agg` holds in 4 KB.
PAGE = 32_768
#: Slots of a filter at most: 128 MB, for 67 million rows of 16 slots each.
MAX_SLOTS = 1 << 30


def _probes(of: Column, pages: int) -> tuple[Column, list[Column]]:
    """The page a hash belongs to and its two slots there."""
    a, b = F.xxhash64(of), F.xxhash64(of, F.lit(1))
    return F.pmod(a, F.lit(pages)), [F.pmod(F.shiftrightunsigned(b, n), F.lit(PAGE)).cast("int") for n in (0, 24)]


def repeat_filter(hashes: DataFrame, col: str, slots_per_row: int = 16, max_slots: int = MAX_SLOTS) -> tuple[DataFrame, int]:
    """Pages (page, bits) of the slots reached at least twice, and the number of pages.

    The filter takes max_slots / 8 bytes at most (128 MB), which bounds the broadcast at any size of input. Beyond
    max_slots / slots_per_row rows it has fewer slots a row (2 at half a billion) and fills up: more rows are then
    shuffled, and none is treated wrongly.
    """
    pages = next_power(hashes.count() * slots_per_row, PAGE, max_slots) // PAGE
    page, slots = _probes(F.col(col), pages)
    # A row's two slots may coincide; array_distinct keeps such a row from reaching a slot twice by itself.
    reached = hashes.select(page.alias("page"), F.explode(F.array_distinct(F.array(*slots))).alias("slot")).groupBy("page", "slot").agg(F.count("*").alias("n"))
    twice = reached.where("n > 1").select("page", F.expr("bitmap_bit_position(slot + 1L)").alias("at"))
    return twice.groupBy("page").agg(F.expr("bitmap_construct_agg(at)").alias("bits")), pages


def _bit(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(slot, F.lit(8)) + 1)) > 0


def flagged(df: DataFrame, hash_col: str, filter_pages: DataFrame, pages: int, flag: str) -> DataFrame:
    """df with a boolean column: whether the row's text is possibly repeated."""
    page_col, bits_col = fresh(df, "page", "bits")
    page, slots = _probes(F.col(hash_col), pages)
    joined = df.withColumn(page_col, page).join(F.broadcast(filter_pages.toDF(page_col, bits_col)), page_col, "left")
    hit = F.coalesce(_bit(F.col(bits_col), slots[0]) & _bit(F.col(bits_col), slots[1]), F.lit(False))
    return joined.withColumn(flag, hit).drop(page_col, bits_col)


def member_filter(keys: DataFrame, col: str, slots_per_key: int = 16, max_slots: int = MAX_SLOTS) -> tuple[DataFrame, int]:
    """Pages of the slots that any key reaches; bounded as those of `repeat_filter`."""
    pages = next_power(keys.count() * slots_per_key, PAGE, max_slots) // PAGE
    page, slots = _probes(F.col(col), pages)
    reached = keys.select(page.alias("page"), F.explode(F.array(*slots)).alias("slot")).select("page", F.expr("bitmap_bit_position(slot + 1L)").alias("at"))
    return reached.groupBy("page").agg(F.expr("bitmap_construct_agg(at)").alias("bits")), pages


def maybe_in(df: DataFrame, col: str, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean column: whether the row's value may be among the keys. keys must be settled."""
    bits, pages = member_filter(keys, key)
    return flagged(df, col, settle(bits), pages, flag)
