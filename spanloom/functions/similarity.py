"""Relevance: BM25 on quantised lengths, and the interface for other models."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldStats:
    """Over all documents: their number, how many have the field, and the field's terms in all."""

    max_doc: int
    doc_count: int
    sum_ttf: int
    sum_df: int = -1


@dataclass(frozen=True)
class TermStats:
    df: int
    ttf: int = -1


def length_steps(most: int = 1 << 31) -> list[float]:
    """The values a quantised length takes, ascending: a length counts as the first value that is not below it.

    Lengths are kept as 1/sqrt(n) with two bits of fraction, so the values are 1/q^2, q = 4..7 times powers of 2.
    """
    out, scale = [1.0], 1.0
    while out[-1] < most:
        out += [1 / (m * scale / 8) ** 2 for m in (7, 6, 5, 4)]
        scale /= 2
    return out


STEPS = length_steps()


def quantised_length(n: Column) -> Column:
    out = F.when(n <= STEPS[0], F.lit(STEPS[0]))
    for value in STEPS[1:]:
        out = out.when(n <= math.floor(value), F.lit(value))
    return out.otherwise(F.lit(STEPS[-1]))


def byte_of_norm(f: float) -> int:
    """A positive float in a byte: 3 bits of mantissa, 5 of exponent."""
    small = struct.unpack("<i", struct.pack("<f", f))[0] >> 21
    low = (63 - 15) << 3
    if small <= low:
        return 0 if struct.unpack("<i", struct.pack("<f", f))[0] <= 0 else 1
    return 255 if small >= low + 256 else small - low


def norm_of_byte(b: int) -> float:
    return 0.0 if b == 0 else struct.unpack("<f", struct.pack("<i", ((b & 255) << 21) + ((63 - 15) << 24)))[0]


def sloppy_factor(distance: float) -> float:
    return 1 / (distance + 1)


class Similarity:
    """A scoring model; subclass and override to plug in another."""

    def score(self, freq: Column, length: Column | None, field: FieldStats, terms: list[TermStats], boost: float) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class BM25(Similarity):
    k1: float = 1.2
    b: float = 0.75

    @staticmethod
    def idf(field: FieldStats, term: TermStats) -> float:
        n = field.max_doc if field.doc_count == -1 else field.doc_count
        return math.log(1 + (n - term.df + 0.5) / (term.df + 0.5))

    @staticmethod
    def average_length(field: FieldStats) -> float:
        if field.sum_ttf <= 0:
            return 1.0
        return field.sum_ttf / (field.max_doc if field.doc_count == -1 else max(1, field.doc_count))

    def score(self, freq: Column, length: Column | None, field: FieldStats, terms: list[TermStats], boost: float = 1.0) -> Column:
        """length: in terms; None for fields without norms."""
        weight = sum(self.idf(field, t) for t in terms) * boost * (self.k1 + 1)
        freq = freq.cast("double")
        if length is None:
            return weight * freq / (freq + self.k1)
        return weight * freq / (freq + self.k1 * ((1 - self.b) + self.b * quantised_length(length) / self.average_length(field)))

    def explain(self, freq: float, dl: float | None, field: FieldStats, terms: list[TermStats], boost: float = 1.0) -> tuple[float, list[tuple[float, str]]]:
        """The value of a score and its parts."""
        idf, average = sum(self.idf(field, t) for t in terms), self.average_length(field)
        norm = self.k1 if dl is None else self.k1 * ((1 - self.b) + self.b * dl / average)
        tf = (self.k1 + 1) * freq / (freq + norm)
        parts = [(boost, "boost")] * (boost != 1) + [(idf, f"idf, from {', '.join(f'docFreq={t.df}' for t in terms)}, docCount={field.doc_count}"), (tf, f"tfNorm, from freq={freq:g}, k1={self.k1:g}, b={self.b:g}, avgFieldLength={average:g}, fieldLength={dl or 0:g}")]
        return idf * tf * boost, parts


class NonScoring(Similarity):
    def score(self, freq: Column, length: Column | None, field: FieldStats, terms: list[TermStats], boost: float = 1.0) -> Column:
        return F.lit(0.0)
