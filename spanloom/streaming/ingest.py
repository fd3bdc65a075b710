"""Near-real-time: a stream of changes into snapshots, and searchers that follow them."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.mutation import IndexWriter, current, exists, latest, read, upsert
from spanloom.schema import FieldSpec
from spanloom.sources.index import Searcher, TableIndex


class _Upsert(IndexWriter):
    def upsert(self, docs: DataFrame) -> int:
        return self._add(lambda old: docs if old is None else upsert(old, docs, self.id_col))

    def delete_keys(self, keys: DataFrame) -> int:
        return self._add(lambda old: None if old is None else old.join(keys, self.id_col, "left_anti"))


def ingest(changes: DataFrame, path: str, id_col: str, fields: Sequence[FieldSpec | str], checkpoint: str, seq: str = "seq_no", op: str = "op", keep: int = 2, **trigger) -> StreamingQuery:
    """Starts a stream of rows (seq_no, op: add or delete, the document's columns) into the index at path.

    Of a key's changes in a batch the last one counts; across batches later ones do. A batch that is replayed after a
    failure leads to the same documents, as upserts and deletes by key are idempotent.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        newest = latest(df, id_col, seq).persist()
        writer = _Upsert(df.sparkSession, path, id_col, fields, keep=keep)
        writer.upsert(newest.where(F.col(op) != "delete").drop(op, seq))
        writer.delete_keys(newest.where(F.col(op) == "delete").select(id_col))
        writer.commit()
        newest.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class SearcherManager:
    """Holds a searcher on the newest snapshot; refreshing swaps it, listeners hear of it before and after.

    A refresh that finds another one under way returns at once, unless it is told to wait.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, fields: Sequence[FieldSpec | str], factory: Callable[[TableIndex], Searcher] = Searcher) -> None:
        if not exists(spark, path):
            raise FileNotFoundError(f"no index at {path}")
        self.spark, self.path, self.id_col, self.fields, self.factory = spark, path, id_col, list(fields), factory
        self.listeners: list[tuple[Callable[[], None], Callable[[bool], None]]] = []
        self._lock = threading.Lock()
        self._load()

    def _load(self) -> None:
        version = current(self.spark, self.path)
        searcher = self.factory(TableIndex(read(self.spark, self.path, version), self.id_col, self.fields))
        self.version, self._searcher = version, searcher

    def acquire(self) -> Searcher:
        """The current searcher; it stays valid while its snapshot is kept."""
        return self._searcher

    def add_listener(self, before: Callable[[], None], after: Callable[[bool], None]) -> None:
        self.listeners.append((before, after))

    def is_current(self) -> bool:
        return current(self.spark, self.path) == self.version

    def maybe_refresh(self, wait: bool = False) -> bool:
        """Whether this call had its turn; False if another refresh was under way."""
        if not self._lock.acquire(blocking=wait):
            return False
        try:
            for before, _ in self.listeners:
                before()
            changed = not self.is_current()
            if changed:
                self._load()
            for _, after in self.listeners:
                after(changed)
            return True
        finally:
            self._lock.release()
