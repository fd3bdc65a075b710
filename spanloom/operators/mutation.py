"""Changes to a set of documents, and a writer that publishes them as snapshots.

The functions are plans on DataFrames. `IndexWriter` buffers changes with ascending sequence numbers, and a commit
writes the documents they lead to into a new folder, then moves the pointer file: readers see the old snapshot or the
new one. A delete or an update reaches documents added before it only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.query import Query, Term, boolean
from spanloom.schema import FieldSpec
from spanloom.sources.index import Searcher, StoredIndex, TableIndex
from spanloom.sources.snapshots import current, exists, in_files, publish, read, remove, vacuum

FieldTerm = tuple[str, str]


def _matching(index: TableIndex, query: Query) -> DataFrame:
    return Searcher(index).hits(query, scoring=False).select(F.col("doc_id").alias(index.id_col)).distinct()


def delete_by_query(index: TableIndex, query: Query, limit: int | None = None) -> DataFrame:
    """Documents that do not match. With a limit, the smallest ids that match go, so many at most."""
    gone = _matching(index, query)
    if limit is not None:
        gone = gone.orderBy(index.id_col).limit(limit)
    return index.docs.join(gone, index.id_col, "left_anti")


def delete_by_terms(index: TableIndex, *terms: FieldTerm) -> DataFrame:
    """Documents that hold none of the terms."""
    return delete_by_query(index, boolean(shoulds=[Term(f, t) for f, t in terms]))


def update(index: TableIndex, term: FieldTerm, new: DataFrame) -> DataFrame:
    """Documents without those that hold the term, and the new ones."""
    return delete_by_terms(index, term).unionByName(new, allowMissingColumns=True)


def upsert(docs: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The newest document of each key: new ones replace old ones."""
    return docs.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(changes: DataFrame, key: str, seq: str = "seq_no") -> DataFrame:
    """Of a change log, the last row of each key, by partial aggregates."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.col(seq)).alias("__row")).select("__row.*")


def update_numeric(index: TableIndex, query: Query, column: str, value: Column | float | bytes | str, index_sort: Sequence[str] = ()) -> DataFrame:
    """Documents with a column of numbers, or of binary values, set where the query matches."""
    if column in index_sort:
        raise ValueError(f"{column!r} is part of the index sort")
    frame = index.frame(query, Searcher(index).similarity, scoring=False)
    value = value if isinstance(value, Column) else F.lit(value)
    kind = index.docs.schema[column].dataType
    match = query.compile(frame)[0]
    return frame.df.withColumn(column, F.when(match, value.cast(kind)).otherwise(F.col(column))).select(*index.docs.columns)


def last_updates(updates: DataFrame, docs: DataFrame, key: str, column: str, seq: str = "seq_no") -> DataFrame:
    """docs with the newest value of each key in updates (key, value, seq)."""
    newest = updates.groupBy(key).agg(F.max_by("value", seq).alias("__value"), F.lit(True).alias("__has"))
    return docs.join(newest, key, "left").withColumn(column, F.when(F.col("__has"), F.col("__value")).otherwise(F.col(column))).select(*docs.columns)


def index_sorted(docs: DataFrame, segments: int, *keys: Column | str) -> DataFrame:
    """Documents in so many segments, each sorted."""
    return docs.repartition(segments).sortWithinPartitions(*keys)


def compact(docs: DataFrame, deletes: DataFrame | None, key: str, segments: int, sort: Sequence[str] = ()) -> DataFrame:
    """Live documents in so many segments; deletes: (key), and seq_no where documents have one."""
    if deletes is not None:
        live = docs.join(deletes.select(key).distinct(), key, "left_anti")
        if "seq_no" in deletes.columns and "seq_no" in docs.columns:
            last = deletes.groupBy(key).agg(F.max("seq_no").alias("__deleted"))
            live = docs.join(last, key, "left").where(F.col("__deleted").isNull() | (F.col("seq_no") > F.col("__deleted"))).drop("__deleted")
        docs = live
    return docs.repartition(segments).sortWithinPartitions(*sort) if sort else docs.repartition(segments)


def plan_merges(sizes: dict[str, int], at_once: int = 10, most: int = 5 << 30, per_tier: int = 5, floor: int = 2 << 20, live: Mapping[str, float] | None = None, reclaim: float = 2.0) -> list[list[str]]:
    """Files to merge together: of sizes alike, small ones first, no result above `most` bytes. Sizes under the floor
    count as it; as many files as the tiers allow stay. live: the share of a file's rows that are not deleted; a file
    counts by its live part, and merges that reclaim more come first."""
    whole = dict(sizes)
    sizes = {n: int(size * (live or {}).get(n, 1.0)) for n, size in sizes.items()}
    order = sorted((n for n in sizes if sizes[n] < most / 2), key=lambda n: (-sizes[n], n))
    total, level, allowed = sum(sizes[n] for n in order), max(floor, min((sizes[n] for n in order), default=floor)), 0
    while total > level * per_tier:
        allowed, total, level = allowed + per_tier, total - level * per_tier, level * at_once
    allowed += -(-total // level) if order else 0
    out: list[list[str]] = []
    while len(order) > allowed:
        best: tuple[float, list[str]] | None = None
        for k in range(len(order)):
            group, size = [], 0
            for n in order[k:]:
                if len(group) < at_once and size + sizes[n] <= most:
                    group.append(n)
                    size += sizes[n]
            if len(group) > 1:
                skew = max(floor, sizes[group[0]]) / sum(max(floor, sizes[n]) for n in group)
                kept = size / max(1, sum(whole[n] for n in group))
                score = skew * max(1, size) ** 0.05 * kept**reclaim
                best = (score, group) if best is None or score < best[0] else best
        if best is None:
            break
        out.append(best[1])
        order = [n for n in order if n not in best[1]]
        allowed -= 1
    return out


def merge_by_policy(index: StoredIndex, **options) -> StoredIndex:
    """The index after the merges that its segments' sizes and deletions call for, one version for each."""
    for group in plan_merges(index.sizes(), live=index.live_shares(), **options):
        index = index.merge(only=group)
    return index


class IndexWriter:
    """Publishes snapshots of a set of documents under a path of any Hadoop file system; one writer at a time.

    mode: create starts empty, append needs a snapshot, create_or_append takes what there is.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, fields: Sequence[FieldSpec | str], mode: str = "create_or_append", keep: int = 1) -> None:
        self.spark, self.path, self.id_col, self.fields, self.keep = spark, path, id_col, list(fields), keep
        self.open, self.seq_no = True, 0
        self._changes: list[tuple[int, Callable[[DataFrame | None], DataFrame | None]]] = []
        there = exists(spark, path)
        if mode == "append" and not there:
            raise FileNotFoundError(f"no index at {path}")
        self.version = current(spark, path) if there and mode != "create" else 0
        self._base = self.version
        if mode == "create" and there:
            self._base = 0
            self.version = current(spark, path)

    def _add(self, change: Callable[[DataFrame | None], DataFrame | None]) -> int:
        if not self.open:
            raise ValueError("the writer is closed")
        self.seq_no += 1
        self._changes.append((self.seq_no, change))
        return self.seq_no

    def _index(self, docs: DataFrame) -> TableIndex:
        return TableIndex(docs, self.id_col, self.fields)

    def add_documents(self, docs: DataFrame) -> int:
        """Adds a block of documents; returns its sequence number."""
        return self._add(lambda old: docs if old is None else old.unionByName(docs, allowMissingColumns=True))

    def update_documents(self, term: FieldTerm, docs: DataFrame) -> int:
        """Deletes what holds the term and adds documents, as one change."""
        return self._add(lambda old: docs if old is None else update(self._index(old), term, docs))

    def delete_by_terms(self, *terms: FieldTerm) -> int:
        return self._add(lambda old: None if old is None else delete_by_terms(self._index(old), *terms))

    def delete_by_queries(self, *queries: Query, limit: int | None = None) -> int:
        def change(old: DataFrame | None) -> DataFrame | None:
            for q in queries:
                old = None if old is None else delete_by_query(self._index(old), q, limit)
            return old

        return self._add(change)

    def delete_all(self) -> int:
        return self._add(lambda old: None if old is None else old.limit(0))

    def update_numeric(self, term: FieldTerm, column: str, value: float) -> int:
        return self._add(lambda old: None if old is None else update_numeric(self._index(old), Term(*term), column, value))

    def has_uncommitted_changes(self) -> bool:
        return bool(self._changes)

    def documents(self) -> DataFrame | None:
        """The documents as all changes so far leave them, committed or not."""
        docs = read(self.spark, self.path, self._base) if self._base else None
        for _, change in self._changes:
            docs = change(docs)
        return docs

    def reader(self) -> Searcher | None:
        """A searcher on the uncommitted state."""
        docs = self.documents()
        return None if docs is None else Searcher(self._index(docs))

    def commit(self, segments: int | None = None) -> int:
        """Publishes the changes; returns the snapshot's version. Nothing to publish keeps the version."""
        if not self._changes:
            return self.version
        docs = self.documents()
        version = self.version + 1
        if docs is not None:
            self._write(docs, f"{self.path}/snapshot-{version}", segments)
            publish(self.spark, self.path, version)
            self.version = self._base = version
            vacuum(self.spark, self.path, self.keep)
        self._changes = []
        return self.version

    def _write(self, docs: DataFrame, path: str, segments: int | None) -> None:
        """Writes documents, in so many files if that is asked: by as many tasks as there are, and then joined."""
        if not segments:
            docs.write.mode("overwrite").parquet(path)
            return
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        docs.write.parquet(aside)
        if not in_files(self.spark, aside, path, segments):
            self.spark.read.schema(docs.schema).parquet(aside).repartition(segments).write.mode("overwrite").parquet(path)
        remove(self.spark, aside)

    def force_merge(self, segments: int) -> int:
        """Publishes the documents in so many files."""
        self._add(lambda old: old)
        return self.commit(segments)

    def rollback(self) -> None:
        self._changes, self.open = [], False

    def close(self) -> None:
        self.commit()
        self.open = False

    def counts(self) -> dict[str, int]:
        docs = self.documents()
        return {"num_docs": 0 if docs is None else docs.count(), "version": self.version}


def apply_log(changes: Iterable[tuple[str, object]], writer: IndexWriter) -> list[int]:
    """Feeds a log of (operation, argument) to a writer: add, update, delete_terms, delete_query, numeric."""
    calls = {
        "add": lambda a: writer.add_documents(a), "update": lambda a: writer.update_documents(*a), "delete_terms": lambda a: writer.delete_by_terms(*a),
        "delete_query": lambda a: writer.delete_by_queries(a), "numeric": lambda a: writer.update_numeric(*a),
    }
    return [calls[op](arg) for op, arg in changes]
