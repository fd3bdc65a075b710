"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows up to which a side table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


Model = TypeVar("Model")
_held: dict[tuple, object] = {}


def trim() -> None:
    """Gives freed memory back to the system, where its C library can."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if give:
        give(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that few rows' results are held at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def let_go() -> None:
    """Drops the model that this Python worker holds and gives freed memory back to the system.

    Workers go on from stage to stage, so what one leaves behind counts against the next.
    """
    _held.clear()
    trim()


def held(make: Callable[..., Model], *key: Hashable) -> Model:
    """make(*key), kept until this worker needs another model."""
    if (make, key) not in _held:
        let_go()
        _held[make, key] = make(*key)
    return _held[make, key]  # type: ignore[return-value]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanloom-"))
    return context.getCheckpointDir()  # a folder of this session's in the one named


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared checkpoint folder, so that lost executors do not undo it."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `settle`, but by a written table, for loops: a checkpoint hands on its plan's estimated size, and where settled
    tables are joined in each round, the digits of that number double until planning takes all the time."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As `stored`, with the folder, for `forget`."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Frees the disk of a stored table that no plan reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most so many rows. df must be settled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def next_power(n: float, least: int, most: int) -> int:
    """The smallest power of two from n up, within [least, most]; both are powers of two."""
    return max(least, min(most, 1 << max(0, int(n) - 1).bit_length()))
