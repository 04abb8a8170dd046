"""Shared pieces: the cluster's scratch folder, staged tables, row keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.operators.staging import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only a session on one machine may go without."""
    return shared_folder(spark)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a
    reread and never a rerun of the plan above them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.at(name))
        self.names.add(name)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def put(self, name: str, data: bytes) -> str:
        """A small file of the driver's own making; returns its place."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(data)
        finally:
            out.close()
        return self.at(name)

    def keep(self, *names: str) -> None:
        """Drop all other tables."""
        self.drop(*(self.names - set(names)))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        self.names -= set(names)
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give back what this process has freed; the allocators would keep it for themselves."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, which gives memory back at its end: Spark keeps
    the worker for tasks of any later stage, beside those that are busy."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


def values_of(column: pa.Array, rows: int = 256) -> Iterator:
    """The column's values in order, of which only a few are Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def ascii_lower(column: Column) -> Column:
    """A-Z only: lower() would also fold other letters."""
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's text, modulo folds, equals fold; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
