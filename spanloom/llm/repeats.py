"""Removal of long repeated strings: bucket-pointer refinement of sampled suffixes.

Suffixes start in the buckets of their q-grams. A bucket of one suffix is done. The others are refined by the bucket
identifiers found at later offsets, their pointers: the bucket of a suffix at twice the depth is named by its own
identifier and the one as many units later, and the new identifiers are used again for the next depth, from 8 bytes
(taken as they are) over 16, 32, 64 and 128 to 256. A string of any length from there up is named by the pointers of
suffixes that cover it. Names are 64-bit numbers that follow from the pair alone, so that every task gives a string
the same name and none has to look another's buckets up; sorting by them is left to aggregates and joins.

Not every suffix needs a bucket. Equal strings of a scale's length hold equal q-grams at equal places, and the one with
the least name in each is the same: their anchor, about one byte in 170. Anchors that are alone in their bucket go first.
The windows of an anchor start within its reach. All of them are settled at once if the string that spans them is in a
bucket with another. Else their starts are split into blocks, and those into smaller ones, down to single starts: a block
is settled if the string that spans its windows is in a bucket with another suffix (every window is repeated), or if the
string common to its windows is alone (none is). Of a settled bucket one suffix goes on, as a witness for those still open.

There are two scales: strings of LENGTH bytes that start at another place, which are removed, and passages of PASSAGE
words in another row, which are counted (`n_shared_words`), as most of so many words are shorter than LENGTH bytes.

What is stored a row an anchor, suffix or block is stored by column, which takes less disk than checkpoints of rows.
No text is gathered by key: buckets are partial aggregates, and what adaptive joins split has settled sides. Texts with
open suffixes are found by a Bloom filter of bounded size and read again. A false match needs two equal 64-bit names of
different strings in buckets of one q-gram.

Cases: a null text counts as empty; texts under LENGTH bytes lose nothing. Repeated rows are copies of each other.
Null ids are carried. Runs of one byte match at every shift, as the definition has it. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bloom import maybe_in
from spanloom.llm.common import forget, let_go, settle, stored, stored_at
from spanloom.llm.shingles import paired, pieces, word_hashes, word_places

LENGTH, PASSAGE = 400, 51


@dataclass(frozen=True)
class Scale:
    """Units a repeated string has, units of the initial buckets of anchors, and sizes of the blocks of starts."""

    length: int
    gram: int
    blocks: tuple[int, ...]

    @property
    def reach(self) -> int:
        return self.length - self.gram


BYTES, WORDS = 0, 1
#: A string under refinement has 4 to 12 grams' units: its blocks' common string and its anchor's longest span.
SCALES = (Scale(LENGTH, 64, (48, 8, 1)), Scale(PASSAGE, 8, (6, 1)))
LEVELS = max(len(s.blocks) for s in SCALES)
#: Units whose buckets are named together; a power of two above numbers their places.
TOGETHER, PLACES = 1 << 18, np.uint64((1 << 20) - 1)
#: Texts, and suffixes under refinement, of a batch.
ROWS = 1000
#: id and check name a row: rows of one id with different texts are told apart, equal rows are alike.
ROW = ["id", "check"]
LISTED = "id long, check long, kind byte, place long, low short, high short, gram long, span long, who long"
SUFFIX = ["kind", "place", "low", "high", "gram", "lo", "hi"]


def buckets(units: np.ndarray, kind: int) -> np.ndarray:
    """The bucket of the gram at each place, by refinement from the least depth. Units: bytes, or hashes of words."""
    ids, depth = (pieces(units)[: max(0, len(units) - 7)].copy(), 8) if kind == BYTES else (units, 1)
    while depth < SCALES[kind].gram and len(ids):
        ids, depth = paired(ids[:-depth], ids[depth:]), 2 * depth
    return ids


def strings(ids: np.ndarray, gram: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of strings of 4 to 12 grams' units, by the pointers of suffixes that cover them."""

    def deeper(at: np.ndarray) -> np.ndarray:
        twice = lambda p: paired(ids[p], ids[p + gram])
        return paired(twice(at), twice(at + 2 * gram))

    last = ends - 4 * gram
    return paired(paired(deeper(starts), deeper((starts + last) // 2)), deeper(last) + (ends - starts).astype(np.uint64))


def parted(texts: list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Parts (text, place, units) of texts, about TOGETHER units a list. Each window of `length` is in one part."""
    out, size = [], 0
    for k, units in enumerate(texts):
        for at in range(0, len(units) - length + 1, TOGETHER):
            out.append((k, at, units[at : at + TOGETHER + length - 1]))
            size += len(out[-1][2])
            if size >= TOGETHER:
                yield out
                out, size = [], 0
    if out:
        yield out


def anchors(parts: list[tuple[int, int, np.ndarray]], kind: int) -> list[np.ndarray]:
    """Text, place, least and greatest start relative to it (of the windows with this anchor), gram's bucket and name of
    the string that all those windows span, of the parts' anchors."""
    scale = SCALES[kind]
    sizes = np.array([len(u) for _, _, u in parts])
    base = np.cumsum(sizes) - sizes
    ids = buckets(np.concatenate([u for _, _, u in parts]), kind)
    # The least name in each window's reach, the first of equal ones, by running minima from both sides of fixed blocks.
    width = scale.reach + 1
    keyed = np.full(-(-len(ids) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    keyed[: len(ids)] = (ids & ~PLACES) | np.arange(len(ids), dtype=np.uint64)
    grid = keyed.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = sizes - scale.length + 1
    of = np.repeat(np.arange(len(parts)), windows)
    start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows - base, windows)
    place = (np.minimum(behind[start], ahead[start + scale.reach]) & PLACES).astype("int64")
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    own, part = place[first], of[first]
    text, at = (np.array([p[k] for p in parts])[part] for k in (0, 1))
    low, high = start[first] - own, start[last] - own
    return [text, own - base[part] + at, low, high, ids[own], strings(ids, scale.gram, own + low, own + high + scale.length)]


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of all words of texts, parted by a byte, and the hashes of each text's words."""
    joined = np.frombuffer(b" ".join(raws), "uint8")
    starts, ends = word_places(joined)
    sizes = np.array([len(r) for r in raws]) + 1
    first = np.searchsorted(starts, np.cumsum(sizes)[:-1])
    return starts, ends, np.split(word_hashes(joined, starts, ends), first)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.crc32(text.cast("binary")).alias("check"), text.alias("text"))


def _list(columns: str):
    """Anchors of each text, of these columns. `who` tells what a string must differ in to be another one: the place, or
    the row."""
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                raws = [t.as_py().encode() for t in batch.column("text")]
                rows = batch.column("row").to_numpy()
                for kind, texts in ((BYTES, [np.frombuffer(r, "uint8") for r in raws]), (WORDS, words_of(raws)[2])):
                    for parts in parted(texts, SCALES[kind].length):
                        text, place, low, high, gram, span = anchors(parts, kind)
                        who = paired(rows[text].astype("uint64"), place.astype("uint64")).view("int64") if kind == BYTES else rows[text]
                        made = {"kind": np.full(len(text), kind, "int8"), "place": place, "low": low.astype("int16"), "high": high.astype("int16"), "gram": gram.view("int64"), "span": span.view("int64"), "who": who}
                        yield pa.RecordBatch.from_arrays([pa.array(made[c]) if c in made else batch.column(c).take(pa.array(text)) for c in names], names)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The string around each open suffix: all of its windows."""
    types = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [*ROW, *SUFFIX, "around"])

    for batch in batches:
        edges, fields = _flat(batch.column("parts"), len(SUFFIX))
        for n, (id_, check, text) in enumerate(zip(*(batch.column(c) for c in (*ROW, "text")))):
            raw, name, words = text.as_py().encode(), (id_.as_py(), check.as_py()), None
            for part in zip(*(x[edges[n] : edges[n + 1]] for x in fields)):
                kind, place, low, high = part[:4]
                first, last = place + low, place + high + SCALES[kind].length
                if kind == WORDS:
                    words = word_places(np.frombuffer(raw, "uint8")) if words is None else words
                    first, last = words[0][first], words[1][last - 1]
                out.append((*name, *part, raw[first:last]))
                if len(out) >= ROWS:
                    yield made()
                    out = []
    yield made()


def _blocks(level: int):
    """For each open suffix, its open blocks of the level's size, the names of what their windows have in common and of
    what they span (null where the suffix has a part of the block only)."""

    def of_kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        scale = SCALES[kind]
        size, parent = scale.blocks[level], scale.blocks[max(0, level - 1)]
        low, high = (batch.column(c).to_numpy().astype("int64") for c in ("low", "high"))
        around = batch.column("around").to_pylist()
        units = np.frombuffer(b"".join(around), "uint8") if kind == BYTES else np.concatenate(words_of(around)[2])
        sizes = high - low + scale.length
        base = np.cumsum(sizes) - sizes - low  # where the anchor lies
        outer, lo, hi = (batch.column("open").flatten().field(k).to_numpy() for k in range(3))
        # The parent's blocks, and those parts of them that the suffix has.
        step = parent // size
        number = np.repeat(np.arange(len(outer)), step)
        owner = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("open")).to_numpy())[number]
        block = (outer.astype("int64")[:, None] * step + np.arange(step)).ravel()
        begin, end = np.maximum(block * size, -scale.reach), np.minimum(block * size + size - 1, 0)
        has = (begin <= end) & (end >= low[owner]) & (begin <= high[owner])
        number, owner, block, begin, end = number[has], owner[has], block[has], begin[has], end[has]
        full = (begin >= low[owner]) & (end <= high[owner])
        ids, at = buckets(units, kind), base[owner]
        common = strings(ids, scale.gram, at + end, at + begin + scale.length)
        span = np.zeros(len(at), np.uint64)
        span[full] = strings(ids, scale.gram, (at + begin)[full], (at + end)[full] + scale.length)
        first, last = np.maximum(begin, low[owner]), np.minimum(end, high[owner])
        arrays = [batch.column("suffix").take(pa.array(owner)), batch.column("gram").take(pa.array(owner)), pa.array(lo[number]), pa.array(hi[number]), pa.array(block.astype("int32")), pa.array(first.astype("int16")), pa.array(last.astype("int16"))]
        arrays += [pa.array(common.view("int64")), pa.array(span.view("int64"), mask=~full)]
        return pa.RecordBatch.from_arrays(arrays, ["suffix", "gram", "lo", "hi", "block", "first", "last", "common", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                kinds = batch.column("kind").to_numpy()
                for kind in (BYTES, WORDS):
                    if (kinds == kind).any():
                        yield of_kind(batch.filter(pa.array(kinds == kind)), kind)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        edges, (kinds, begins, ends) = _flat(batch.column("spans"), 3)
        for k, text in enumerate(batch.column("text")):
            raw, kept, removed, n, at = text.as_py().encode(), hashlib.sha256(), 0, 0, 0
            runs: tuple[list, list] = ([], [])
            for kind, begin, end in zip(*(x[edges[k] : edges[k + 1]] for x in (kinds, begins, ends))):
                runs[kind].append((begin, end))
            for begin, end in merged(runs[BYTES]):
                kept.update(raw[at:begin])
                removed, n, at = removed + end - begin, n + 1, end
            kept.update(raw[at:])
            found.append((len(raw), removed, n, kept.hexdigest(), sum(end - begin for begin, end in merged(runs[WORDS]))))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"])


def _flat(lists: pa.ListArray, fields: int) -> tuple[list[int], list[list]]:
    """Edges of lists of structs (a null list is empty), and their fields' values in one list each."""
    edges = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy()]).tolist()
    flat = lists.flatten()
    return edges, [flat.field(k).to_pylist() for k in range(fields)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _shared(rows: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """Buckets that hold more than one string: key, lo and hi (the least and the greatest it holds)."""
    return settle(rows.groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *more).where("lo <> hi"))


def _settled(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of blocks (settled): (suffix, first, last) of those that are repeated throughout, and (suffix, block, lo, hi) of
    those that go on: open ones, and a witness of each settled bucket that shares its common string with one. Blocks of
    one start, the last, have one string and are settled or gone."""
    common, span = ["gram", "block", "common"], ["gram", "block", "common", "span"]
    alive = settle(rows.join(_shared(rows, common).select(*common), common, "left_semi"))
    if last:
        return alive.select("suffix", "first", "last"), None
    twice = _shared(alive.where("span is not null"), span, F.min("suffix").alias("suffix"))
    judged = settle(alive.join(twice.select(*span, F.lit(True).alias("whole")), span, "left"))
    still = judged.where("whole is null")
    witness = twice.join(settle(still.select(*common).distinct()), common, "left_semi").select("suffix", "block", "lo", "hi")
    return judged.where("whole").select("suffix", "first", "last"), still.select("suffix", "block", "lo", "hi").unionByName(witness)


def repeated_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """kind, id, check, begin, end: ranges of units that are all repeated, and together hold each repeated unit. They
    overlap."""
    rows = _rows(df, id_col, text_col)
    long_enough = rows.where(F.octet_length("text") >= min(LENGTH, 2 * PASSAGE - 1)).withColumn("row", F.monotonically_increasing_id())
    # Anchors are listed twice, so that those alone in their bucket are neither stored nor shuffled but for its name.
    who = [F.min("who").alias("lo"), F.max("who").alias("hi")]
    first = "gram long, who long"
    grams = settle(long_enough.mapInArrow(_list(first), first).groupBy("gram").agg(*who).where("lo <> hi").select("gram"))
    listed, listed_at = stored_at(maybe_in(long_enough.mapInArrow(_list(LISTED), LISTED), "gram", grams, "gram", "maybe").where("maybe").drop("maybe"))
    pointer = ["gram", "span", "low", "high"]
    twice = settle(listed.groupBy(*pointer).agg(*who, F.min(F.struct(*ROW, "place")).alias("one"), F.min("kind").alias("kind")).where("lo <> hi"))
    judged = stored(listed.join(twice.select(*pointer, F.lit(True).alias("whole")), pointer, "left"))
    forget(df.sparkSession, listed_at)
    length = F.when(F.col("kind") == BYTES, SCALES[BYTES].length).otherwise(SCALES[WORDS].length)
    found = judged.where("whole").select("kind", *ROW, (F.col("place") + F.col("low")).alias("begin"), (F.col("place") + F.col("high") + length).alias("end"))

    still = settle(judged.where("whole is null").drop("whole", "span").join(grams, "gram", "left_semi")).withColumns({"lo": F.col("who"), "hi": F.col("who")})
    witness = twice.join(settle(still.select("gram").distinct()), "gram", "left_semi").select("one.*", *pointer, "kind", "lo", "hi")
    going = still.select(*ROW, *SUFFIX).unionByName(witness.select(*ROW, *SUFFIX))
    parts = settle(going.groupBy(*ROW).agg(F.collect_set(F.struct(*SUFFIX)).alias("parts")).withColumn("name", row_name()))
    texts = maybe_in(rows.withColumn("name", row_name()), "name", parts, "name", "maybe").where("maybe").select("name", "text")
    contexts = texts.join(parts, "name").select(*ROW, "text", "parts").mapInArrow(_contexts, "id long, check long, kind byte, place long, low short, high short, gram long, lo long, hi long, around binary")
    around = stored(contexts.withColumn("suffix", F.monotonically_increasing_id()))
    inner = []
    least = [F.lit(-s.reach // s.blocks[0]) for s in SCALES]
    every = F.sequence(F.when(F.col("kind") == BYTES, least[BYTES]).otherwise(least[WORDS]), F.lit(0))
    asked = around.withColumn("open", F.transform(every, lambda b: F.struct(b.alias("block"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))))
    for level in range(LEVELS):
        made, made_at = stored_at(asked.select("suffix", "kind", "low", "high", "gram", "around", "open").mapInArrow(_blocks(level), "suffix long, gram long, lo long, hi long, block int, first short, last short, common long, span long"))
        whole, opened = _settled(made, level == LEVELS - 1)
        forget(df.sparkSession, made_at)
        inner.append(whole)
        if opened is not None:
            grouped = settle(opened.groupBy("suffix").agg(F.collect_set(F.struct("block", "lo", "hi")).alias("open")))
            asked = maybe_in(around, "suffix", grouped, "suffix", "maybe").where("maybe").drop("maybe").join(grouped, "suffix")
    names = around.select("suffix", "kind", *ROW, "place")
    for whole in inner:
        found = found.unionByName(whole.join(names, "suffix").select("kind", *ROW, (F.col("place") + F.col("first")).alias("begin"), (F.col("place") + F.col("last") + length).alias("end")))
    return found


def row_name() -> Column:
    """A row's name for joins: its id and check, null-safe."""
    return F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("check").cast("string"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words."""
    spans = settle(repeated_spans(df, id_col, text_col).groupBy(*ROW).agg(F.collect_set(F.struct("kind", "begin", "end")).alias("spans")).select(row_name().alias("name"), "spans"))
    rows = maybe_in(_rows(df, id_col, text_col).withColumn("name", row_name()), "name", spans, "name", "maybe")
    none = F.lit(0).cast("long")
    alone = rows.where("not maybe").select("id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), none.alias("n_shared_words"))
    cut = rows.where("maybe").join(spans, "name", "left").select("id", "text", "spans").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")
    return alone.unionByName(cut).withColumnRenamed("id", id_col)
