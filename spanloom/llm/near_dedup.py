"""Near-duplicate components by SetSketch registers.

Each document's set of word shingles gives REGISTERS registers, exponentially spaced truncations of the least of
exponential hash values, mergeable by maximum and equal in two sets with about their similarity. Documents with equal
sets are one node. Registers are banded; nodes that share a band's values meet in a bucket, where their registers'
joint likelihood estimates similarity. Estimates clearly under the threshold go; the rest make families. A family's
full sets are then compared exactly, and only confirmed links join documents.

Neither step emits pairs. In a bucket or family, a breadth-first search compares a node only with those that no link
has reached yet, and gives a star for each component found. Large buckets and families are dealt as blocks, so that
none gathers in a task: blocks are compared within and with one node of all, and only what that does not join meets
all blocks (see `compared`). A link of similarity 0.8 misses all bands with a probability of 5e-8, and is estimated
below the margin with about 1e-6.

Cases: null and empty texts, and those of white space, have an empty set: no links, and a component of their own.
Fewer words than a shingle are one shingle. Rows of equal sets share a component. Null ids take part; a component's
id is its smallest non-null id, and `kept` compares null-safe. Repeated rows are alike, kept ones too. An empty table
gives an empty result. Other columns are ignored, and carried by `drop_near_copies`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bloom import maybe_in
from spanloom.llm.common import fresh, let_go, settle, sliced, stored
from spanloom.llm.shingles import mixed, shingles

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: SetSketch's base, rate and largest register value.
SPACING, RATE, TOP = 1.001, 20.0, 65_534
#: Estimates so many standard deviations under the threshold are still compared exactly.
MARGIN = 5.0
#: Nodes, and shingles of nodes, of a block; a group holds two blocks at most.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 19
#: Rows of a batch that are hashed, or handed on with their sets, together.
TOGETHER = 200

_draw = np.random.default_rng(77)
_FACTORS = _draw.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BAND_FACTORS = _draw.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(own: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    short, least = (own >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    rate = -np.log1p(-(least.astype("float64") + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(rate) / math.log(SPACING)), 0, TOP + 1).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash of each band's values; registers: (nodes, REGISTERS)."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS
    return mixed(parts.sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view("int64")


def estimate(own: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Similarity by likelihood: greater, smaller and equal registers have probabilities that follow from the set
    sizes and the similarity; a bisection on the slope of the log-likelihood finds its maximum."""
    equal = (others == own).sum(axis=1)
    greater = (others < own).sum(axis=1)
    smaller = REGISTERS - equal - greater
    u = n / (n + sizes)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(20):
        j = (low + high) / 2
        slope = equal / np.maximum(j, 1e-9) - greater * v / np.maximum(u - v * j, 1e-9) - smaller * u / np.maximum(v - u * j, 1e-9)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return low


def stars(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(center, member) of the components of a graph, a node compared only with nodes not reached yet."""
    out, left = [], np.arange(n)
    while len(left):
        center, left = left[0], left[1:]
        queue = [center]
        while queue and len(left):
            found = linked(queue.pop(), left)
            reached = left[found]
            left = left[~found]
            queue += reached.tolist()
            out += [(center, k) for k in reached.tolist()]
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows of one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, end in zip([0, *edges], [*edges, len(keys)]):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if held and held[0].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


EDGES = "part long, a binary, b binary"


def compared(rows_of: Callable[[DataFrame], DataFrame], nodes_of: Callable[[DataFrame], DataFrame], groups: DataFrame, key: str, cols: list[str], compare: Callable) -> DataFrame:
    """Edges (a, b) that join all rows of a key which `compare` links, in groups of bounded size. groups: key, blocks (how
    many its rows make), rate (blocks a row), pivot (its first node); settled. rows_of gives the rows (node, cols) of some
    of the groups, with the groups' columns, and nodes_of those without cols.

    A key of one block is one group. Of a larger one, blocks are compared within first, each with the pivot; this takes
    rows in proportion to the key's. Rows that this does not join with the pivot, a few as a rule, then meet every block,
    so that no link is lost.
    """
    run = lambda df: by_part(df, *cols).mapInArrow(compare, EDGES)
    dealt = lambda n, more: F.pmod(F.xxhash64("node", F.lit(more)), n).cast("int")
    own = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).otherwise(F.array(dealt(F.col("blocks"), 3)))
    placed = lambda df: df.withColumn("part", F.explode(own)).withColumn("part", F.xxhash64(key, "part"))
    within = settle(run(placed(rows_of(groups))))
    known = within.drop("part")
    large = settle(groups.where("blocks > 1"))
    if not large.limit(1).count():
        return known
    reached = within.select("part", F.col("b").alias("node"), F.col("a").alias("center"))
    inner = (F.col("node") == F.col("pivot")) | F.coalesce(F.col("center") == F.col("pivot"), F.lit(False))
    first = settle(placed(nodes_of(large)).join(reached, ["part", "node"], "left").select(key, "node", inner.alias("inner")).distinct())
    most = settle(first.groupBy(key).agg(F.sum(F.col("inner").cast("long")).alias("largest"), F.sum((~F.col("inner")).cast("long")).alias("others")).where("others > 0"))
    if not most.limit(1).count():
        return known
    met = rows_of(settle(large.join(most.select(key), key, "left_semi"))).join(settle(first.join(most, key)), [key, "node"])
    inside, outside = (F.ceil(F.col(c) * F.col("rate")).cast("int") for c in ("largest", "others"))
    own = F.when(F.col("inner"), dealt(inside, 5)).otherwise(inside + dealt(outside, 5))
    pairs = _pairs(own, F.when(F.col("inner"), F.sequence(inside, inside + outside - 1)).otherwise(F.sequence(F.lit(0), inside + outside - 1)))
    return known.unionByName(run(met.withColumn("pair", F.explode(pairs)).withColumn("part", F.xxhash64(key, "pair"))).drop("part"))


def _pairs(own: Column, others: Column) -> Column:
    """The pairs of a row's block and other ones."""
    return F.transform(F.filter(others, lambda b: b != own), lambda b: F.struct(F.least(b, own).alias("a"), F.greatest(b, own).alias("b")))


def by_part(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("part", *cols).repartition("part").sortWithinPartitions("part", "node")  # the first is a star's center


def _edges(part: int, pairs: list[tuple[int, int]], nodes: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([part] * len(pairs), pa.int64()), *(pa.array([nodes[p[k]] for p in pairs], pa.binary()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, ["part", "a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node in edges (a, b): by the stars of larger neighbours and of smaller ones, in turn."""
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    size = links.count()
    while size:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Both sides of each join are settled, so that adaptive joins can split a node with many neighbours.
        least = stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m")))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = stored(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("v <> u").distinct()
        new = stored(small)
        count = new.count()
        done = count == size and not new.join(links, ["v", "u"], "left_anti").limit(1).count()
        links, size = new, count
        if done:
            break
    roots = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stored(roots.unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()))


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, check (CRC-32 of the text), n (set size), node (digest of the set; null if empty), registers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches, TOGETHER):
            sizes, nodes, registers = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), width)
                sizes.append(len(own))
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                registers.append(sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("check"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(registers, pa.binary())], ["id", "check", "n", "node", "registers"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), check(F.col(text_col)).alias("check"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "id long, check long, n long, node binary, registers binary")


def families(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join all nodes whose estimates may reach the threshold. nodes: node, n, registers; settled."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bands(np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("node").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], ["band", "node"])

    margin = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        found: list[tuple[int, bytes, bytes]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "a", "b"])

        for group in groups(batches, "part"):
            part, names, sizes = group.column("part")[0].as_py(), group.column("node").to_pylist(), group.column("n").to_numpy()
            registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for a, b in stars(len(names), lambda x, left: estimate(registers[x], registers[left], sizes[x], sizes[left]) >= margin):  # noqa: B023
                found.append((part, names[a], names[b]))
            if len(found) > 10_000:
                yield made()
                found = []
        yield made()

    # Bands are made twice, so that those that are alone are neither stored nor shuffled but for their hash.
    banded = nodes.select("node", "registers").mapInArrow(band, "band long, node binary")
    often = settle(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band"))
    met = settle(maybe_in(banded, "band", often, "band", "maybe").where("maybe").drop("maybe"))
    shared = met.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1")
    sized = settle(shared.select("band", F.ceil(F.col("members") / BLOCK_NODES).alias("blocks"), F.lit(1 / BLOCK_NODES).alias("rate"), "pivot"))
    nodes_of = lambda some: met.join(some, "band")
    return compared(lambda some: nodes_of(some).join(nodes, "node"), nodes_of, sized, "band", ["node", "n", "registers"], compare)


def confirmed(df: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that join all members whose full sets are linked. members: name (of a row), node, n, root; settled."""
    sums = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.min("node").alias("pivot"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.least(F.col("members"), F.ceil(F.col("total") / BLOCK_SHINGLES)))
    sized = settle(sums.select("root", blocks.cast("long").alias("blocks"), (blocks / F.col("members")).alias("rate"), "pivot"))
    named = df.select(row_name(F.col(id_col)).alias("name"), F.col(text_col).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches, TOGETHER):
            own = [shingles(t.as_py(), width) for t in batch.column("text")]
            # Of several rows with a name, those of another set are not the member meant.
            same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == node.as_py() for x, node in zip(own, batch.column("node"))]
            cols = [batch.column(c) for c in ("root", "node", "blocks", "rate", "pivot")] + [pa.array([x.tobytes() for x in own], pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["root", "node", "blocks", "rate", "pivot", "hashes"]).filter(pa.array(same))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for group in groups(batches, "part"):
            names = group.column("node").to_pylist()
            own = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
            if len(own) > 1:
                yield _edges(group.column("part")[0].as_py(), exact_stars(own, percent), names)

    def rows_of(some: DataFrame) -> DataFrame:
        placed = settle(members.join(some, "root"))
        # Texts of no member stay where they are, but for what the filter's bounded size lets through.
        texts = maybe_in(named, "name", placed, "name", "maybe").where("maybe").join(placed, "name")
        return texts.mapInArrow(sets, "root binary, node binary, blocks long, rate double, pivot binary, hashes binary")

    return compared(rows_of, lambda some: members.join(some, "root"), sized, "root", ["node", "hashes"], compare)


def exact_stars(own: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Stars of the sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(x) for x in own])
    everything = np.concatenate(own)
    owner = np.repeat(np.arange(len(own)), sizes)
    order = np.argsort(everything, kind="stable")
    ordered, owner = everything[order], owner[order]
    number = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) - 1
    shared = np.bincount(number) > 1  # others are in no intersection
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    width = int(shared.sum())
    by_owner = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_owner], np.arange(len(own) + 1))
    held = number[by_owner]
    mark = np.zeros(width, bool)
    alive = owner[by_owner]

    def linked(x: int, left: np.ndarray) -> np.ndarray:
        mine = held[starts[x] : starts[x + 1]]
        if len(left) * 4 < len(own):
            parts = [held[starts[k] : starts[k + 1]] for k in left]
            lengths = [len(p) for p in parts]
            flat, at = (np.concatenate(parts) if parts else held[:0]), np.repeat(np.arange(len(left)), lengths)
        else:
            flat, at = held, alive
        mark[mine] = True
        hits = np.bincount(at[mark[flat]], minlength=len(left) if flat is not held else len(own))
        mark[mine] = False
        both = hits if flat is not held else hits[left]
        return 100 * both >= percent * (sizes[x] + sizes[left] - both)

    return stars(len(own), linked)


def row_name(id_: Column) -> Column:
    return F.coalesce(id_.cast("long").cast("string"), F.lit("null"))


def check(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def judged(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """One row per row of df: id, check, n, component_id, kept."""
    rows = settle(sketches(df, id_col, text_col, width))
    nodes = settle(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers")))
    near = components(families(nodes.select("node", "n", "registers"), percent / 100))
    members = settle(nodes.select("node", "n", row_name(F.col("id")).alias("name")).join(near, "node"))
    linked = components(confirmed(df, members, id_col, text_col, width, percent))
    found = nodes.select("node", "id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = settle(found.groupBy("root").agg(F.min("id").alias("component_id")))
    named = settle(found.select("node", "root").join(ids, "root").select("node", "component_id"))
    out = rows.select("id", "check", "n", "node").join(named, "node", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select("id", "check", "n", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept."""
    return judged(df, id_col, text_col, width, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df without the rows that another one of their component stands for; all columns stay. A row is known by its id
    and its text's checksum. Texts are shuffled only where the filter of those that go may hold them."""
    name, flag = fresh(df, "name", "maybe")
    known = lambda id_, sum_: F.concat_ws(":", row_name(id_), sum_.cast("string"))
    gone = settle(judged(df, id_col, text_col, width, percent).where("not kept").select(known(F.col("id"), F.col("check")).alias(name)).distinct())
    marked = maybe_in(df.withColumn(name, known(F.col(id_col), check(F.col(text_col)))), name, gone, name, flag)
    left = marked.where(F.col(flag)).join(gone, name, "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(~F.col(flag)).select(*columns).unionByName(left.select(*columns))
