"""Tables written between rounds of a loop, in the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read.

    Where none is set, a session on one machine (a test, a laptop) gets one of
    its own; on a cluster a machine's own folder wouldn't do, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graftwork-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores: a small file of many rows is one task's, however much work a row is."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


class Rounds:
    """Writes each round's table, so that plans stay short and a lost executor costs a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Delete the n-th table, which nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
