"""What the operators share: the shared work folder, written tables, file access by URI, tables by name."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []
#: The folders of each open scope; the first list is of those that no scope removes.
_scopes: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a temporary folder does for
    a local master; on a cluster, whose executors couldn't see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="skarn-"))
        found = _local[0]
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder.  It goes with the innermost scope, or with the one around that if it outlives it."""
    path = f"{shared_dir(spark)}/skarn/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _scopes[-2 if outlives and len(_scopes) > 1 else -1].append(path)
    return path


def remove(spark: SparkSession, path: str, pattern: str = "") -> None:
    """Removes a folder of the shared one, or what in it has names like the pattern."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, pattern)) or ()] if pattern else [at]:
        fs.delete(x, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Paths made inside are removed at its end, but for those that outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has left in the shared folder; frames that read it can't be used any more."""
    remove(spark, f"{shared_dir(spark)}/skarn/{spark.sparkContext.applicationId}")
    _scopes[0].clear()


def written(df: DataFrame, name: str, compression: str = "none", outlives: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and a lost executor costs nothing.
    Such tables are mostly numbers that don't compress, and a codec holds buffers outside the heap."""
    spark = df.sparkSession
    path = work_path(spark, name, outlives)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is that of a column of df, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hashable(df: DataFrame) -> list[Column]:
    """The columns that can be hashed: not those with maps or variants in them."""
    return [df[f"`{f.name}`"] for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]


#: Rows that are broadcast at most, by count; they are of a few numbers each.
BROADCAST_ROWS = 200_000


def without(df: DataFrame, keys: list[str], gone: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df whose keys are not in gone, a written table of keys.  Few of those are broadcast, so that df stays
    where it is."""
    return df.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, keys, "left_anti")


#: A key of more than this share of all rows is heavy; so there are fewer than its inverse of them.
HEAVY = 0.001


def looked_up(df: DataFrame, by: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """df joined to by, a written table with one row a key and the number of rows that df has for it; total: all of df's.  If
    those are few, by is broadcast, else its few heavy keys, so that no task gets all rows of one, and the rest shuffled."""
    if total <= BROADCAST_ROWS:  # so by has no more rows
        return df.join(F.broadcast(by.drop(count)), key, how)
    heavy = by.where(F.col(count) > HEAVY * total).drop(count)
    light = df.join(F.broadcast(heavy.select(key)), key, "left_anti").join(by.where(F.col(count) <= HEAVY * total).drop(count), key, how)
    return df.join(F.broadcast(heavy), key).unionByName(light)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text"):
    """The text column, null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


#: Bytes of a batch that passes from the JVM to Python; by rows alone it would grow with the length of the texts.
BATCH_BYTES = "2m"


def batched(df: DataFrame) -> DataFrame:
    """df, its session set to pass at most about BATCH_BYTES (or one row) at once to Python.  That is a setting of the
    session, read when a plan runs, so frames that are returned need it for as long as they live; one that is set is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What run makes of df's batches, in tasks that give freed memory back to the system before the next one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return batched(df).mapInArrow(task, schema)


class Files:
    """Files under one URI, for Python tasks: the local file system directly, others through pyarrow.fs."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        if self.uri.startswith("file:") or "://" not in self.uri:
            self.fs, self.root = None, "/" + self.uri.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(self.uri)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            return open(self.path(name), "wb")
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self.path(name))

    def open(self, name: str):
        return open(self.path(name), "rb") if self.fs is None else self.fs.open_input_file(self.path(name))

    def move(self, old: str, new: str) -> None:
        """Puts a finished file in its place.  A second attempt of the same task writes the same bytes there, so where a
        file system doesn't replace a file, the one that is there stays."""
        if self.fs is None:
            os.replace(self.path(old), self.path(new))
            return
        try:
            self.fs.move(self.path(old), self.path(new))
        except OSError:
            there, mine = self.fs.get_file_info([self.path(new), self.path(old)])
            if not there.is_file or there.size != mine.size:
                raise
            self.fs.delete_file(self.path(old))

    def drop(self, name: str) -> None:
        """Removes the file of an attempt that has failed, if it is there."""
        try:
            os.remove(self.path(name)) if self.fs is None else self.fs.delete_file(self.path(name))
        except OSError:
            pass


def drawn(df: DataFrame, key: str, k: int) -> DataFrame:
    """Distinct values of a column, those with the smallest hashes, at most k of them: a sample with a fixed bound that
    depends on the values alone.  All but about 2 * k are left out where they are read, so that nothing large is sorted
    in one place; nulls are never drawn."""
    known = df.where(df[key].isNotNull()).select(key)
    n, h = known.count(), F.xxhash64(key)
    if n > 2 * k:
        known = known.where(h < -(1 << 63) + int((1 << 64) * (2 * k / n)))
    return known.distinct().orderBy(F.xxhash64(key), key).limit(k)


def ranges(df: DataFrame, key: str, n: int, sample: int = 20_000, of: DataFrame | None = None) -> DataFrame:
    """df dealt to n partitions by ranges of the integer column key, nulls first.  The bounds are quantiles of a bounded
    sample of the keys (used for nothing else), so they don't depend on how df is laid out; they are drawn from `of`, if
    given.  Adds the range's number as __part."""
    keys = np.sort(np.array([r[0] for r in drawn(df if of is None else of, key, min(sample, 64 * n)).collect()], np.int64))
    bounds = keys[[len(keys) * i // n for i in range(1, n)]] if len(keys) else keys

    @F.pandas_udf("int")
    def part(s: pd.Series) -> pd.Series:
        null = s.isna()
        return pd.Series(np.where(null, 0, np.searchsorted(bounds, s.fillna(0).astype(np.int64), side="right")).astype(np.int32))

    return df.withColumn("__part", part(F.col(key).cast("long"))).repartitionById(n, F.col("__part"))
