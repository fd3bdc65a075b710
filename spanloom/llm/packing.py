"""Best-fit packing planned on the histogram of piece lengths.

Documents become token ids with an end id; longer ones are cut into full sequences, the first piece taking what does
not fill one. Best fit decreasing then runs over the counts of each length, not over documents: bins of equal
history are one entry with a count, so the plan has a few thousand entries whatever the input. Pieces take the
planned slots by their rank within their length, and ranks come from counts by (length, task that cut them), so that
neither a long text nor a common length gathers in one task, and pieces are neither sorted nor, unless there are many
tasks, shuffled.

Cases: a null or empty text is the end id alone. Repeated rows (equal ids) are packed each. Null ids are packed as
any other. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import BROADCAST_ROWS, held, settle

CAPACITY, END = 1024, 2
#: Units of text whose ids a worker remembers; further ones are encoded anew each time.
REMEMBERED = 200_000
PIECES = "id long, piece int, start long, length long, ids_crc32 long"

#: Where cutting a text at its spaces could part what the tokenizer takes together: white space beside white space or
#: at an end, white space other than space and line feed (what only Python takes for white space included), and the
#: name of the special token.
_WHOLE = re.compile(r"[ \n][ \n]|\A[ \n]|[ \n]\Z|[^\S \n]|<\|endoftext\|>")


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers.

    Every single space between other characters starts a new unit for a byte-level BPE with this pattern, so a text's
    ids are those of its units, which repeat. A text where that might not hold goes to the tokenizer as a whole.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.name = tokenizer

    @cached_property
    def tokenizer(self):
        """Loaded for the rare texts that need it."""
        import public_tokenizers
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path(self.name))

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.units.encode_ordinary(" " + unit)).tobytes()
        if len(self) < REMEMBERED and len(unit) < 64:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|endoftext|>" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _WHOLE.search(text):
            return array("I", self.units.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.units.encode_ordinary(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def cut_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, part (the task that cut it) and nth (its place among the
    task's pieces of its length). Another run may number them otherwise, so that they hold once settled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = held(Encoder, tokenizer, ranks), array("I", [end]).tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for id_, text in zip(batch.column(0), batch.column(1)):
                ids = known.encode(text.as_py() or "") + last
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    for column, value in zip(out, (id_, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), seen[n])):
                        column.append(value.as_py() if column is out[0] else value)
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [*(pa.array(c, t) for c, t in zip(out, types)), pa.array([part] * len(out[0]), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"{PIECES}, nth long, part int")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: entries (length, first rank, ranks, bins, first bin, offset).

    The pieces of a length with ranks first rank + i, i < ranks, go to bin first bin + i % bins at place
    offset + i // bins * length. Bins of the same room are one group; a piece goes to the group with the least room
    that it fits, and fills each of its bins as often as it can, as best fit would.
    """
    out, groups, made = [], {}, 0  # groups: by room, [(first bin, bins)]
    rooms: list[int] = []

    def leave(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, bins: int, room: int, times: int, length: int = length) -> None:
            nonlocal left, rank
            out.append((length, rank, bins * times, bins, first, capacity - room))
            left, rank = left - bins * times, rank + bins * times
            leave(room - times * length, first, bins)

        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no room: new bins
                room, times = capacity, capacity // length
                bins = left // times or 1
                put(made, bins, room, min(times, left))
                made += bins
                continue
            room = rooms[at]
            first, bins = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            times = min(room // length, left)
            full = min(bins, left // times)
            leave(room, first + full, bins - full)
            put(first, full, room, times)
    return out


def ranked(pieces: DataFrame, lengths: int) -> DataFrame:
    """pieces with rank: from 0 within a length, by part, then by place within it. pieces must be settled; lengths: how
    many they have."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = counts.select("length", "part", before.alias("before"))
    if lengths * pieces.rdd.getNumPartitions() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(cut_pieces(df, id_col, text_col, tokenizer, ranks, capacity, end))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = np.array(plan(histogram, capacity), "int64").reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One key for (length, rank): lengths start at multiples of a number above every rank.
        stride = int(slots[:, 1:3].sum(axis=1).max(initial=0)) + 1
        keys = slots[:, 0] * stride + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length * stride + rank, "right") - 1]
            nth = rank - slot[:, 1]
            columns = [batch.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(slot[:, 4] + nth % slot[:, 3]), pa.array(slot[:, 5] + nth // slot[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    packed = ranked(pieces, len(histogram)).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
