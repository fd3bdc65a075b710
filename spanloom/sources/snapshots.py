"""Published versions under a path of any Hadoop file system: a file for each version."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot was published."""
    return bool(_versions(spark, path))


def current(spark: SparkSession, path: str) -> int:
    """The version of the newest snapshot."""
    return _versions(spark, path)[-1]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot-{version or current(spark, path)}")


def publish(spark: SparkSession, path: str, version: int) -> None:
    """Makes a written snapshot the newest: a file is made aside and moved, which is atomic."""
    fs, aside = _files(spark, f"{path}/.{uuid.uuid4().hex}")
    fs.create(aside).close()
    if not fs.rename(aside, _files(spark, f"{path}/current-{version}")[1]):
        fs.delete(aside, False)
        raise FileExistsError(f"version {version} of {path} was published by another writer")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Removes all snapshots but the newest `keep`; returns their versions."""
    old = _versions(spark, path)[: -max(1, keep)]
    for v in old:
        for name in (f"{path}/current-{v}", f"{path}/snapshot-{v}"):
            remove(spark, name)
    return old


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def in_files(spark: SparkSession, source: str, target: str, n: int) -> bool:
    """Makes n Parquet files under target of those that one write left under source, alike in size; False if there are
    fewer. Row groups are copied as they are, through a small buffer: no task reads what goes into a file, and readers
    still share a file's row groups."""
    parquet, conf = spark._jvm.org.apache.parquet, spark._jsc.hadoopConfiguration()
    fs, p = _files(spark, source)
    found = sorted(((s.getLen(), s.getPath().getName(), s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")), key=lambda x: (-x[0], x[1]))
    if len(found) < n:
        return False
    groups: list[list] = [[] for _ in range(n)]
    sizes = [0] * n
    for length, _, file in found:
        k = sizes.index(min(sizes))
        sizes[k] += length + 1
        groups[k].append(parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    fs.delete(_files(spark, target)[1], True)
    for k, files in enumerate(groups):
        reader = parquet.hadoop.ParquetFileReader.open(files[0])
        head = reader.getFileMetaData()
        reader.close()
        out = parquet.hadoop.util.HadoopOutputFile.fromPath(_files(spark, f"{target}/part-{k:05d}-{uuid.uuid4().hex}.parquet")[1], conf)
        writer = parquet.hadoop.ParquetFileWriter(out, head.getSchema(), parquet.hadoop.ParquetFileWriter.Mode.CREATE, 128 << 20, 8 << 20)
        writer.start()
        for file in files:
            writer.appendFile(file)
        writer.end(head.getKeyValueMetaData())
    return True


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    fs, p = _files(spark, path)
    return fs.getContentSummary(p).getLength()


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder that driver and executors share: under spark.checkpoint.dir, or, in local mode only, a
    temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{shared}/spanloom-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spanloom-")
