"""Tokenizers as column expressions: text to arrays of terms in order of position."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token ends at this many UTF-8 bytes; the rest is the next token.
MAX_TOKEN_BYTES, MAX_WORD_CHARS = 511, 128
SPACE = r"(?U)\s+"
#: Runs of anything but the characters with Unicode's White_Space property (fixed values), as SPACE has it.
TOKEN = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

#: What those characters are in UTF-8, and which single bytes are one.
SPACES = [chr(c).encode() for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SPACE_BYTES = np.isin(np.arange(256), [s[0] for s in SPACES if len(s) == 1])
#: What a vectorised function takes at a time, so that what it makes stays small, however much comes in a batch.
SLICE_TOKENS, SLICE_BYTES, SLICE_ROWS = 1 << 18, 1 << 20, 1 << 14


def _cut(token: Column) -> Column:
    """A token as the array of its parts of MAX_TOKEN_BYTES bytes or just above, by whole characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(state: Column, c: Column) -> Column:
        held = F.concat(state["held"], c)
        full = F.octet_length(held) >= MAX_TOKEN_BYTES
        return F.struct(F.when(full, F.concat(state["done"], F.array(held))).otherwise(state["done"]).alias("done"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    cut = F.aggregate(F.split(token, ""), start, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))
    return F.when(F.octet_length(token) < MAX_TOKEN_BYTES, F.array(token)).otherwise(cut)


def whitespace(text: Column) -> Column:
    """Terms between runs of Unicode white space, case kept; null text has none. A term's index is its position."""
    parts = F.filter(F.split(text, SPACE), lambda t: t != "")
    long = F.exists(parts, lambda t: F.octet_length(t) >= MAX_TOKEN_BYTES)
    return F.coalesce(F.when(long, F.flatten(F.transform(parts, _cut))).otherwise(parts), F.array().cast("array<string>"))


def whitespace_values(values: Column) -> Column:
    """Terms of a multi-valued field: positions go on from value to value without a gap."""
    return F.coalesce(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), whitespace)), F.array().cast("array<string>"))


def whole(value: Column) -> Column:
    """The value as its only term, for keyword and binary fields; null has none."""
    return F.when(value.isNull(), F.array()).otherwise(F.array(value))


def words(values: Column) -> Column:
    """Terms of pre-segmented words (value, begin, length): distinct, by begin then length, cut to MAX_WORD_CHARS. Equal
    words are neighbours once sorted, so each is compared with the one before it, not with all."""
    ordered = F.sort_array(F.transform(values, lambda w: F.struct(w["begin"].alias("begin"), w["length"].alias("length"), w["value"].alias("value"))))
    distinct = F.transform(F.array(ordered), lambda all_: F.filter(all_, lambda w, k: (k == 0) | (w != F.get(all_, k - 1))))[0]
    return F.transform(distinct, lambda w: F.substring(w["value"], 1, MAX_WORD_CHARS))


def _parts(token: str) -> list[str]:
    """A token cut as `_cut` does."""
    if len(token.encode()) < MAX_TOKEN_BYTES:
        return [token]
    out, held = [""], 0
    for c in token:
        if held >= MAX_TOKEN_BYTES:
            out, held = [*out, ""], 0
        out[-1] += c
        held += len(c.encode())
    return out


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `most` units at most, or of one row."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    a, n = 0, len(sizes)
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1), a + SLICE_ROWS, n)
        yield a, b
        a = b


def _lists(edges: np.ndarray, **columns: pa.Array) -> pa.Array:
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)


def _offsets_by_row(texts: pa.Array) -> pa.Array:
    """`offsets` of texts of which some have tokens to be cut."""
    terms: list[str] = []
    places: list[int] = []
    starts: list[int] = []
    edges = [0]
    for value in texts.to_pylist():
        first = len(terms)
        for found in TOKEN.finditer(value or ""):
            start = found.start()
            for part in _parts(found[0]):
                terms.append(part)
                places.append(len(terms) - 1 - first)
                starts.append(start)
                start += len(part)
        edges.append(len(terms))
    ends = [s + len(t) for s, t in zip(starts, terms)]
    return _lists(np.array(edges), term=pa.array(terms, pa.string()), pos=pa.array(places, pa.int32()), start=pa.array(starts, pa.int32()), end=pa.array(ends, pa.int32()))


def _placed(texts: pa.Array) -> tuple[np.ndarray, ...] | None:
    """Of all texts' bytes at once: which belong to tokens, where tokens begin and end, where each text's bytes and
    tokens begin. None if a token is to be cut."""
    sizes = _bytes_of(texts)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    held = pa.concat_arrays([pc.fill_null(texts, "")]).buffers()[2]
    data = np.frombuffer(held, "uint8")[: begins[-1]] if begins[-1] else np.zeros(0, "uint8")
    space = SPACE_BYTES[data]
    for code in SPACES:  # those of two and three bytes
        if len(code) > 1 and len(data) >= len(code):
            at = np.flatnonzero(data[: len(data) - len(code) + 1] == code[0])
            for k, byte in enumerate(code[1:], 1):
                at = at[data[at + k] == byte]
            for k in range(len(code)):
                space[at + k] = True
    word = ~space
    edge = np.zeros(len(data) + 1, bool)  # where a text begins, no token goes on
    edge[begins] = True
    first = np.flatnonzero(word & (np.concatenate([[True], space])[:-1] | edge[:-1]))
    last = np.flatnonzero(word & (np.concatenate([space, [True]])[1:] | edge[1:])) + 1
    if len(first) and (last - first).max() >= MAX_TOKEN_BYTES:
        return None
    return data, word, first, last, begins, np.searchsorted(first, begins)


def _bytes_of(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")


def _terms(data: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(np.concatenate([[0], np.cumsum(last - first)]).astype("int32")), pa.py_buffer(data[word]))


def _offsets(texts: pa.Array) -> pa.Array:
    """`offsets` of a slice."""
    found = _placed(texts)
    if found is None:
        return _offsets_by_row(texts)
    data, word, first, last, begins, edges = found
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[begins[np.repeat(np.arange(len(texts)), np.diff(edges))]]
    places = np.arange(len(first)) - np.repeat(edges[:-1], np.diff(edges))
    return _lists(edges, term=_terms(data, word, first, last), **{k: pa.array(v, pa.int32()) for k, v in (("pos", places), ("start", chars[first] - base), ("end", chars[last] - base))})


def _whitespace(texts: pa.Array) -> pa.Array:
    """`whitespace` of a slice."""
    found = _placed(texts)
    if found is None:
        return pa.array([[p for x in TOKEN.findall(t or "") for p in _parts(x)] for t in texts.to_pylist()], pa.list_(pa.string()))
    return pa.ListArray.from_arrays(pa.array(found[5], pa.int32()), _terms(*found[:4]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("pos", "start", "end"))])))
def offsets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Tokens with places: array of (term, pos, start, end), offsets in characters, end exclusive; null text has none.

    A running place needs an accumulated array in column expressions, which is copied for each token; here it takes
    time in proportion to the text, and memory in proportion to a slice of it.
    """
    for texts in batches:
        for a, b in _slices(_bytes_of(texts), SLICE_BYTES):
            yield _offsets(texts.slice(a, b - a))


def _inverted(tokens: pa.Array) -> pa.Array:
    """`inverted` by one sort of (row, term, position), each packed into a number."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype("int64")
    coded = tokens.flatten().dictionary_encode(null_encoding="encode")
    if not len(coded):
        return _lists(np.zeros(len(sizes) + 1, "int64"), term=pa.array([], pa.string()), tf=pa.array([], pa.int32()), positions=pa.array([], pa.list_(pa.int32())), len=pa.array([], pa.int32()))
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    of_place, of_term = (int(x).bit_length() for x in (sizes.max(), len(coded.dictionary)))
    packed = ((row << of_term | coded.indices.to_numpy()) << of_place) | (np.arange(len(coded)) - begins[row])
    packed.sort()
    group = packed >> of_place
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    group, until = group[first], np.concatenate([first, [len(coded)]])
    positions = pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(packed & ((1 << of_place) - 1), pa.int32()))
    terms = coded.dictionary.take(pa.array(group & ((1 << of_term) - 1))).cast(pa.string())
    row = group >> of_term
    edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
    return _lists(edges, term=terms, tf=pa.array(np.diff(until), pa.int32()), positions=positions, len=pa.array(sizes[row], pa.int32()))


POSTINGS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("len", T.IntegerType())]))


@F.arrow_udf(POSTINGS)
def inverted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A document's terms, in no particular order, with their frequency, their positions and the number of all tokens.
    All of a document's tokens are in its row, so postings need no shuffle to be made; memory is that of a batch as it
    comes and of a slice's postings."""
    for tokens in batches:
        for a, b in _slices(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), SLICE_TOKENS):
            yield _inverted(tokens.slice(a, b - a))


@F.arrow_udf(POSTINGS)
def inverted_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`inverted` of the tokens that `whitespace` makes of a text."""
    for texts in batches:
        for a, b in _slices(_bytes_of(texts), SLICE_BYTES):
            yield _inverted(_whitespace(texts.slice(a, b - a)))
