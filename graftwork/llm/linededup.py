"""Line dedup over levelled sorted runs of line hashes.

Documents go in batches, in the order of their ids (of a hash of ids that are
no numbers). A batch's distinct lines become 128-bit hashes with the number of
documents and the first document that holds them; hashes that the compacted
runs have already settled (they reached the threshold) are anti-joined away,
the rest is written as one more sorted run. Runs are bucketed by hash and
sorted in their buckets, all in the same way, so a batch meets a run by
merging bucket with bucket: the run is not shuffled again. (With
bucketed=False runs are plain sorted files, which a batch meets by a shuffle;
writing them takes less of an executor's memory.) When a level has
`fanout` runs they are merged into one run of the next level. In the end the
runs are merged once and give the hashes over the threshold.

Up to `MAX_HOT` of these go to every task, which drops their lines in one pass
over the documents; nothing is shuffled then. Beyond that hashes are matched
back to the documents by joins: the few that a large share of all lines has
are broadcast, the others shuffled, and each document meets its list. Both
ways give the same rows.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased; keys without a code point are never dropped.

Defined results: a null or empty text is one empty line, which stays. A row
counts as a document of its own, repeated rows too. With keep="first" the
document with the smallest id keeps its lines (nulls come last; repeated rows
of that document all keep them). Texts are split whole. Other columns pass
through, whatever their names; earlier ones named as the outputs are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.llm.common import Scratch, free_name, released, values_of

#: Hashes over the threshold that every task may hold.
MAX_HOT = 500_000
#: At most this many hashes are broadcast when the others are joined by shuffle.
MAX_BROADCAST = 100_000


def line_hash(line: bytes) -> bytes:
    """16 bytes; empty for a key without a code point."""
    key = line.strip().lower()
    return xxhash.xxh3_128_digest(key) if key else b""


class LineRuns:
    """Sorted runs of (h, n, first) by level, bucketed tables in the shared folder."""

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int = 4, bucketed: bool = True):
        self.scratch, self.min_docs, self.fanout, self.bucketed = scratch, min_docs, fanout, bucketed
        self.files: dict[str, DataFrame] = {}
        self.levels: list[list[str]] = []
        self.made = 0
        # as many buckets as a shuffle has partitions, so that what a batch shuffled is written bucket by bucket
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [self.run(name) for level in self.levels for name in level]

    def run(self, name: str) -> DataFrame:
        return self.scratch.spark.table(name) if self.bucketed else self.files[name]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name, self.made = f"run_{uuid.uuid4().hex}_{self.made}", self.made + 1
        if self.bucketed:
            writer = rows.select("h", "n", "first").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h")
            writer.option("path", self.scratch.at(name)).saveAsTable(name)
        else:
            self.files[name] = self.scratch.save(rows.select("h", "n", "first").sortWithinPartitions("h"), name)
        self.levels[level].append(name)

    def drop(self, names: list[str]) -> None:
        for name in names:
            if self.bucketed:
                self.scratch.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(*names)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        all_ = runs[0]
        for more in runs[1:]:
            all_ = all_.unionByName(more)
        return all_.groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def add(self, lines: DataFrame) -> None:
        """One batch of (h, first), a row for each document that holds h."""
        own = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("first").alias("first"))
        for run in self.runs():
            own = own.join(run.filter(F.col("n") >= self.min_docs).select("h"), "h", "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        old = self.levels[level]
        self._write(self._merged([self.run(name) for name in old]), level + 1)
        self.levels[level] = []
        self.drop(old)

    def repeated(self) -> DataFrame:
        """(h, n, first) of hashes in at least min_docs documents."""
        return self._merged(self.runs()).filter(F.col("n") >= self.min_docs)


def line_table(docs: DataFrame, key: str, text: str, batch, with_rows: bool) -> DataFrame:
    """(first, batch, h), and a and b of the row: each distinct line of each document once."""
    names = ["first", "batch"] + (["a", "b"] if with_rows else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, hashes = [], []
            for i, t in enumerate(values_of(batch.column("t").cast(pa.binary()))):
                own = {line_hash(x) for x in t.split(b"\n")} - {b""}
                index += [i] * len(own)
                hashes += own
                if len(index) > 200_000:
                    yield made(batch, index, hashes)
                    index, hashes = [], []
            yield made(batch, index, hashes)

    def made(batch: pa.RecordBatch, index: list[int], hashes: list[bytes]) -> pa.RecordBatch:
        rows = batch.select(names).take(pa.array(index, pa.int32()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(hashes, pa.binary())], names=[*names, "h"])

    # nulls compare as smallest in min(); a flag in front puts them last
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"))
    source = docs.select(first.alias("first"), batch.cast("int").alias("batch"), *(row_key(key, text) if with_rows else []), F.coalesce(text, F.lit("")).alias("t"))
    schema = T.StructType([*(f for f in source.schema.fields if f.name != "t"), T.StructField("h", T.BinaryType())])
    return source.mapInArrow(released(run), schema)


def row_key(key: str, text: str) -> list:
    """Two hashes of a row's id and text; equal rows share them, copies with their own ids don't."""
    return [F.xxhash64(F.lit(salt), F.col(key), F.col(text)).alias(name) for salt, name in enumerate("ab")]


def batch_of(docs: DataFrame, key: str, batches: int):
    """(the batch of a row, how many there are): by quantiles of a number, by a hash of any other id; null ids are in the last."""
    if batches > 1 and isinstance(docs.schema[key].dataType, T.NumericType):
        cuts = docs.agg(F.percentile_approx(key, [i / batches for i in range(1, batches)], 1000)).first()[0]
        bounds = sorted(set(cuts or []))
        at = F.lit(0)
        for b in bounds:
            at = at + F.when(F.col(key) > F.lit(b), 1).otherwise(0)
        return F.when(F.col(key).isNull(), F.lit(len(bounds))).otherwise(at), len(bounds) + 1
    return F.when(F.col(key).isNull(), F.lit(batches - 1)).otherwise(F.pmod(F.xxhash64(key), F.lit(batches))), batches


def dedup_lines(
    spark: SparkSession,
    docs: DataFrame,
    min_docs: int = 10,
    keep: str = "none",
    batches: int = 4,
    fanout: int = 2,
    key: str = "doc_id",
    text: str = "text",
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
    bucketed: bool = True,
) -> DataFrame:
    """Drop lines whose key is in at least min_docs documents.

    keep="none" drops them everywhere, keep="first" keeps those of the first
    document. Returns every row with its text rejoined, the number of lines it
    had and the number dropped.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    scratch = Scratch(spark, "lines")
    batch, n_batches = batch_of(docs, key, batches)
    lines = scratch.save(line_table(docs, key, text, batch, False), "lines", partition_by="batch")
    runs = LineRuns(scratch, min_docs, fanout, bucketed)
    for b in range(n_batches):
        runs.add(lines.filter(F.col("batch") == b))
    hot = scratch.save(runs.repeated(), "hot")
    runs.drop([name for level in runs.levels for name in level])
    total, n_hot = lines.count(), hot.count()
    scratch.drop("lines")

    kept = [f for f in docs.schema.fields if f.name not in (n_lines, n_dropped)]
    out = T.StructType([*kept, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])

    def rewritten(batch: pa.RecordBatch, bad_of) -> pa.RecordBatch:
        """The batch with the lines left out whose hash is bad in their row."""
        texts, total, gone = [], [], []
        for i, t in enumerate(values_of(batch.column(text).cast(pa.binary()))):
            all_ = (t or b"").split(b"\n")
            bad = bad_of(i)
            left = [x for x in all_ if not bad(line_hash(x))] if bad else all_
            texts.append(b"\n".join(left) if len(left) < len(all_) else t)
            total.append(len(all_))
            gone.append(len(all_) - len(left))
        new = pa.array(texts, pa.binary()).cast(pa.string())
        columns = [new if f.name == text else batch.column(f.name) for f in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=out.fieldNames())

    if n_hot <= MAX_HOT:
        owners = {r.h: (r.first["id"] if keep == "first" else None) for r in hot.select("h", *(["first"] if keep == "first" else [])).toLocalIterator()}
        shared = spark.sparkContext.broadcast({bytes(h): x for h, x in owners.items()})

        def by_set(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in parts:
                ids = batch.column(key).to_pylist() if keep == "first" else None

                def bad_of(i: int):
                    if ids is None:
                        return known.__contains__
                    own = ids[i]
                    return lambda h: h in known and known[h] != own

                yield rewritten(batch, bad_of if known else lambda i: None)

        return docs.select(*[f.name for f in kept]).mapInArrow(released(by_set), out)

    # the way beyond: at most MAX_BROADCAST hashes can each have more than this share of the lines
    often = hot.filter(F.col("n") > max(total // MAX_BROADCAST, 100_000)).select("h", F.col("first").alias("kept_by"))
    rest = hot.filter(F.col("n") <= max(total // MAX_BROADCAST, 100_000)).select("h", F.col("first").alias("kept_by"))
    held = line_table(docs, key, text, F.lit(0), True).select("a", "b", "first", "h")
    hits = held.join(F.broadcast(often), "h").unionByName(held.join(rest.hint("merge"), "h"))
    if keep == "first":
        hits = hits.filter(~F.col("first").eqNullSafe(F.col("kept_by")))
    a, b, gone = (free_name(docs, x) for x in ("_gw_a", "_gw_b", "_gw_drop"))
    drop = hits.groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.collect_set("h").alias(gone))

    def by_list(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column(gone).to_pylist()
            yield rewritten(batch, lambda i: set(lists[i]).__contains__ if lists[i] else None)

    names = [f.name for f in kept]
    named = docs.select(*names, *(x.alias(n) for x, n in zip((F.xxhash64(F.lit(s), F.col(key), F.col(text)) for s in range(2)), (a, b))))
    return named.join(drop, [a, b], "left").select(*names, gone).mapInArrow(released(by_list), out)
