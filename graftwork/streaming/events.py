"""Event logs as streams (an addition of ours: the operators above are batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "timestamp_ms bigint, elapsed_ms bigint, pid int, event string, status string, decision string, reason string, fields map<string,string>"


def read_event_log(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """Appended JSON-lines files, as they come."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(folder)


def status_counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events by window and status; windows close when the watermark has passed them."""
    timed = events.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"), F.max("elapsed_ms").alias("longest_ms"))


def append_log(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Copy a stream to appended JSON lines; a batch that is repeated after a failure replaces its own files."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={epoch}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
