"""Exact top-k inner products over a vector-approximation file.

Vectors become integers floor(256 x). The file holds, for each, a cell of 256 for every component, between the vector's
least and greatest, and these two; it is written once. A scan of it gives each query bounds of every row's score, and
keeps the rows whose upper bound reaches the k-th best lower one: the task's while it scans, then that of all tasks.
Only these rows' exact vectors are read, and their scores are certain to hold the k best. Queries are sent to tasks in
blocks of QUERY_BYTES at most; one block holds 65,536 queries of 64 components, and each is one scan of the file.

Of rows with the same vector in a batch, those of the k + 1 smallest ids are looked at, k of each: the rest is behind
them for any query.

Cases: rows with a null id, a null vector, or null or non-finite components take no part. Vectors meet only those of
the same length. Rows that repeat a candidate count each; a query id that occurs with several vectors searches with
the smallest, once, and never meets a row of its own id. Equal scores are ordered by the smaller id. Empty tables
give an empty result. Components are taken as 64-bit integers, the nearest where they are larger, and scores are exact
sums of products; one beyond 64 bits is given as the nearest number of 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.bloom import maybe_in
from spanloom.llm.common import let_go, settle

SCALE, CELLS, K = 256, 256, 5
#: Bytes of the queries sent to tasks at a time.
QUERY_BYTES = 32 << 20
#: Queries, and rows, that meet in one step.
TOGETHER, ROWS = 256, 4096
FILE = "id long, name long, low double, step double, most double, cells binary"
FOUND = "query_id long, id long, name long, lower double, upper double"


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v, the integer vector, and name, its hash, of the rows that take part."""
    usable = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & usable)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    return rows.withColumn("name", F.xxhash64("v"))


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of list."""
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        yield own, flat[offsets[own][:, None] + np.arange(n)]


def _approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for own, matrix in by_length(batch.column("v")):
            exact = matrix.astype("float64")
            low, high = exact.min(axis=1, initial=np.inf), exact.max(axis=1, initial=-np.inf)
            if not matrix.shape[1]:
                low, high = np.zeros(len(own)), np.zeros(len(own))
            step = np.maximum((high - low) / CELLS, 1e-9)
            cells = np.clip((exact - low[:, None]) / step[:, None], 0, CELLS - 1).astype("uint8")
            index = pa.array(own)
            arrays = [batch.column("id").take(index), batch.column("name").take(index), pa.array(low), pa.array(step), pa.array(np.maximum(np.abs(low), np.abs(high))), pa.array([c.tobytes() for c in cells], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "name", "low", "step", "most", "cells"])


class Near:
    """The rows that may be among the k best of queries of one length."""

    def __init__(self, ids: list[int], matrix: list[list[int]], k: int) -> None:
        self.ids, self.k = np.array(ids, "int64"), k
        self.matrix = np.array(matrix, "float64").reshape(len(ids), -1)
        self.sums, self.sizes = self.matrix.sum(axis=1), np.abs(self.matrix).sum(axis=1)
        self.best = np.full((len(ids), k), -np.inf)  # lower bounds
        self.found: list[list[np.ndarray]] = []

    def scan(self, ids: np.ndarray, names: np.ndarray, low: np.ndarray, step: np.ndarray, most: np.ndarray, cells: np.ndarray) -> None:
        order = np.lexsort((ids, names))
        ids_, names_ = ids[order], names[order]
        other_name = np.r_[True, names_[1:] != names_[:-1]]
        other = other_name | np.r_[True, ids_[1:] != ids_[:-1]]
        counted = np.cumsum(other)
        nth_id = counted - np.maximum.accumulate(np.where(other_name, counted, 0))
        at = np.arange(len(order))
        copy = at - np.maximum.accumulate(np.where(other, at, 0))
        kept = np.sort(order[(nth_id <= self.k) & (copy < self.k)])
        for at in range(0, len(kept), ROWS):
            own = kept[at : at + ROWS]
            middle = cells[own].astype("float64") + 0.5
            for q in range(0, len(self.ids), TOGETHER):
                some = slice(q, q + TOGETHER)
                score = (self.matrix[some] @ middle.T) * step[own] + self.sums[some, None] * low[own]
                slack = self.sizes[some, None] * (step[own] / 2 + 1e-9 * most[own]) + 1.0
                score[self.ids[some, None] == ids[own]] = -np.inf
                lower, upper = score - slack, score + slack
                best = np.concatenate([self.best[some], lower], axis=1)
                self.best[some] = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k :]
                which, row = np.nonzero((upper >= self.best[some].min(axis=1)[:, None]) & (upper > -np.inf))
                self.found.append([which + q, ids[own][row], names[own][row], lower[which, row], upper[which, row]])
        if len(self.found) > 64:
            self.found = [self.left()]

    def left(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.found)]
        keep = columns[4] >= self.best.min(axis=1)[columns[0]]
        return [c[keep] for c in columns]


def candidates(file: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """query_id, id, name, lower, upper of the rows that may be among a query's k best of their task."""
    sent = file.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        near = {}
        for n in {len(v) for _, v in sent.value}:
            own = [x for x in sent.value if len(x[1]) == n]
            near[n] = Near([i for i, _ in own], [v for _, v in own], k)
        for batch in batches:
            ids, names, low, step, most = (batch.column(c).to_numpy() for c in range(5))
            cells = batch.column(5).to_pylist()
            sizes = np.array([len(c) for c in cells])
            for n in np.unique(sizes):
                if n in near:
                    own = np.flatnonzero(sizes == n)
                    matrix = np.frombuffer(b"".join(cells[i] for i in own), "uint8").reshape(len(own), n)
                    near[n].scan(ids[own], names[own], low[own], step[own], most[own], matrix)
        for x in near.values():
            if x.found:
                which, *rest = x.left()
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[which]), *map(pa.array, rest)], [c.split()[0] for c in FOUND.split(", ")])

    return file.mapInArrow(scan, FOUND)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of int64 matrices, exactly; the nearest 64-bit number where one is larger."""
    bound = np.abs(a.astype("float64")).max(initial=0) * np.abs(b.astype("float64")).max(initial=0) * max(1, a.shape[1])
    if bound < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    sums = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in sums], "int64")


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df that is a query, its k best rows of df."""
    rows = vectors(df, id_col, vec_col)
    file = settle(rows.mapInArrow(_approximate, FILE))
    queries = settle(vectors(df.where(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    size = queries.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    parts = []
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about query_bytes
        sent = [(r["id"], list(r["v"])) for r in asked]
        near = settle(candidates(file, sent, k))
        # The k-th best lower bound of all tasks; a task adds few rows to a query.
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("lower").desc()))
        least = near.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("lower").alias("least"))
        near = near.join(least, "query_id", "left").where("least is null or upper >= least").select("query_id", "id", "name").distinct()
        parts.append(settle(_exact(rows, settle(near), sent, k)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(rows: DataFrame, near: DataFrame, sent: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """query_id, vec_id, score of candidates, from their exact vectors."""
    asked = rows.sparkSession.sparkContext.broadcast(dict(sent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, matrix in by_length(batch.column("v")):
                index = pa.array(own)
                query = batch.column("query_id").take(index)
                other = np.array([asked.value[q] for q in query.to_pylist()], "int64").reshape(matrix.shape)
                yield pa.RecordBatch.from_arrays([query, batch.column("id").take(index), pa.array(inner_products(matrix.astype("int64"), other))], ["query_id", "vec_id", "score"])

    wanted = settle(near.select("id", "name").distinct())
    # Equal rows count each, but no more than k of them.
    equal = maybe_in(rows, "name", wanted, "name", "maybe").where("maybe").groupBy("id", "name").agg(F.first("v").alias("v"), F.count("*").alias("copies"))
    each = near.join(equal, ["id", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return each.select("query_id", "id", "v").mapInArrow(score, "query_id long, vec_id long, score long")
