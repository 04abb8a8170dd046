"""Sinks (OP-70 to OP-76): JSON reports, appended JSON lines, a guarded output tree."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = ".graftwork-output"


def sorted_keys(df: DataFrame) -> DataFrame:
    """Columns in the order of their names, as appended rows have them."""
    return df.select(*sorted(df.columns))


def append_rows(df: DataFrame, path: str) -> None:
    """Append as JSON lines, keys sorted; a failed task leaves nothing behind."""
    sorted_keys(df).write.mode("append").json(path)


def event(df: DataFrame, name: str, status: Column, started_ms: Column, fields: dict[str, Column] | None = None) -> DataFrame:
    """Event rows: time stamp, elapsed milliseconds, name, status, and a bag of texts."""
    now = F.unix_millis(F.current_timestamp())
    bag = F.create_map(*[x for k, v in (fields or {}).items() for x in (F.lit(k), v.cast("string"))]) if fields else F.create_map().cast("map<string,string>")
    return df.select(now.alias("timestamp_ms"), F.greatest(now - started_ms, F.lit(0)).alias("elapsed_ms"), F.lit(name).alias("event"), status.alias("status"), bag.alias("fields"))


def write_report(df: DataFrame, path: str) -> None:
    """One report row as an indented JSON document, through the cluster's file system."""
    row = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j")).first()
    text = json.dumps(json.loads(row[0]) if row else {}, indent=2, ensure_ascii=False) + "\n"
    _put(df, path, text)


def _put(df: DataFrame, path: str, text: str) -> None:
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def leaves_root(path: Column, root: str) -> Column:
    """Whether a path, absolute or taken from the root, climbs above the root at any point."""
    base = root.rstrip("/") + "/"
    inside = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["out"] | (depth < 0)).alias("out"))

    end = F.aggregate(F.split(inside, "/"), start, step)
    return path.isNull() | inside.startswith("/") | end["out"] | (end["depth"] <= 0)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _checked(files: DataFrame, root: str) -> None:
    """Every path is looked at before anything is written."""
    bad = [r[0] for r in files.filter(leaves_root(F.col("path"), root)).select("path").take(5)]
    if bad:
        raise ValueError(f"paths outside {root}: {bad}")


def _written(files: DataFrame, root: str) -> int:
    """Executors write their rows' files, each whole or not at all; a repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        n = 0
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = posixpath.normpath(path.removeprefix(root.rstrip("/") + "/"))
                target = f"{base}/{own}"
                fs.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
                fs.move(part, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return files.select("path", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_tree(files: DataFrame, root: str) -> int:
    """Write (path, text) files below a root that is new, empty or our own; returns how many.

    A path that leaves the root is refused before anything is written. Of rows
    with one path the last in order of their text stays.
    """
    spark = files.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(base) and len(fs.listStatus(base)) and not _exists(spark, f"{root}/{MARKER}"):
        raise FileExistsError(f"{root} holds files that are not ours")
    _checked(files, root)
    _put(files, f"{root}/{MARKER}", "")
    return _written(files.groupBy("path").agg(F.max("text").alias("text")), root)


def rewrite_sources(files: DataFrame, edited: DataFrame, root: str) -> int:
    """Put edited texts (path, text) in place of the sources that they differ from; returns how many were written.

    Files that the sources lack are not made, and unchanged ones not touched.
    """
    changed = edited.join(files.select("path", F.col("text").alias("_old")), "path").filter("not (text <=> _old)").select("path", "text")
    _checked(changed, root)
    return _written(changed, root)


def summary_lines(df: DataFrame, title: str, counters: list[str], limit: int = 20) -> list[str]:
    """What a console shows of one report row: a title with its counters; more than `limit` counters are told by their number."""
    row = df.select(*counters).first()
    shown = [f"{c}={row[c]}" for c in counters[:limit]] if row else []
    return [f"{title}: {', '.join(shown)}" + (f", … {len(counters) - limit} more" if len(counters) > limit else "")]


def heartbeats(events: DataFrame, interval_ms: int = 15_000) -> DataFrame:
    """(event, started_ms, heartbeat, timestamp_ms): the beats of each event (event, started_ms, ended_ms), one for every whole interval that it ran."""
    n = F.floor((F.col("ended_ms") - F.col("started_ms")) / interval_ms)
    beats = events.filter(n > 0).select("event", "started_ms", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("heartbeat"))
    return beats.withColumn("timestamp_ms", F.col("started_ms") + F.col("heartbeat") * interval_ms)
