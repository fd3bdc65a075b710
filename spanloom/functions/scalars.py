"""Scalar helpers: sortable encodings, display forms and doc-value normal forms."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def segment_name(generation: Column) -> Column:
    return F.concat(F.lit("_"), base36(generation))


def sortable_bits(x: float, kind: str = "double") -> int:
    """An integer in the order of the floats: total order, negative zero below zero."""
    pack, unpack, bits = ("<d", "<q", 63) if kind == "double" else ("<f", "<i", 31)
    n = struct.unpack(unpack, struct.pack(pack, x))[0]
    return n ^ ((n >> bits) & ((1 << bits) - 1))


def sortable_bytes(n: int, size: int = 8) -> bytes:
    """Big-endian bytes whose unsigned order is the integers' order."""
    return ((n + (1 << (8 * size - 1))) % (1 << (8 * size))).to_bytes(size, "big")


def sortable_hex(n: Column) -> Column:
    """Whole numbers as text of 16 digits in their order."""
    return F.lpad(F.hex(n.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def next_up(x: float) -> float:
    return math.nextafter(x, math.inf)


def next_down(x: float) -> float:
    return math.nextafter(x, -math.inf)


def display(col: Column, kind: str) -> Column:
    """A stored value as text: three decimals for floats, six for doubles, an s after shorts."""
    forms = {"float": "%.3f", "double": "%.6f"}
    if kind in forms:
        return F.format_string(forms[kind], col)
    return F.concat(col.cast("string"), F.lit("s")) if kind == "smallint" else col.cast("string")


def sorted_numeric(values: Column) -> Column:
    """A multiset of numbers, ascending; nulls go."""
    return F.array_sort(F.filter(values, lambda v: v.isNotNull()))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def select(values: Column, selector: str) -> Column:
    """One value of a multi-valued key: min, max, middle_min or middle_max."""
    ordered = F.array_sort(values)
    place = {"min": F.lit(1), "max": F.size(ordered), "middle_min": F.floor((F.size(ordered) + 1) / 2), "middle_max": F.floor(F.size(ordered) / 2) + 1}[selector]
    return F.when(F.size(ordered) > 0, F.element_at(ordered, place.cast("int")))
