"""Source positions (OP-33, OP-39b, OP-39c, OP-66)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a bucket of the range join spans.
BUCKET = 256


def extent(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Size of a span: lines weigh 10,000 columns."""
    return (end_line - start_line) * 10_000 + F.greatest(end_col - start_col, F.lit(0))


def innermost(points: DataFrame, spans: DataFrame, group: str = "file", kinds: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the id and kind of the innermost span around it, or nulls.

    points: (point, group, line, col); spans: (id, kind, group, start_line,
    start_col, end_line, end_col), both ends inclusive. Callables come before
    items, then the smaller extent, then the smaller id. The range join is an
    equi-join on the group and a bucket of lines; a span goes to every bucket
    that it touches, so each pair meets once. With `kinds` only spans of these
    kinds count.
    """
    spans = spans.filter(F.col("kind").isin(*kinds)) if kinds else spans
    bucket = lambda line: F.floor(F.col(line) / BUCKET)
    wide = spans.withColumn("_bucket", F.explode(F.sequence(bucket("start_line"), F.greatest(bucket("start_line"), bucket("end_line")))))
    wide = wide.select(group, "_bucket", "id", "kind", "start_line", "start_col", "end_line", "end_col")
    near = points.withColumn("_bucket", bucket("line")).join(wide, [group, "_bucket"])
    after = (F.col("line") > F.col("start_line")) | ((F.col("line") == F.col("start_line")) & (F.col("col") >= F.col("start_col")))
    before = (F.col("line") < F.col("end_line")) | ((F.col("line") == F.col("end_line")) & (F.col("col") <= F.col("end_col")))
    size = extent(*(F.col(c) for c in ("start_line", "start_col", "end_line", "end_col")))
    rank = F.struct((F.col("kind") != "callable").alias("item"), size.alias("extent"), F.col("id").alias("id"))
    best = near.filter(after & before).groupBy("point").agg(F.min_by(F.struct("id", "kind"), rank).alias("owner"))
    return points.join(best, "point", "left").select(*points.columns, F.col("owner.id").alias("owner"), F.col("owner.kind").alias("owner_kind"))


def line_starts(text: Column) -> Column:
    """Character offset at which each line starts."""
    return F.aggregate(
        F.slice(F.split(text, "\n"), F.lit(1), F.size(F.split(text, "\n")) - 1),
        F.array(F.lit(0)),
        lambda acc, line: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(line) + 1)),
    )


def offset_of(text: Column, line: Column, col: Column) -> Column:
    """Offset of a 1-based line and 0-based column; null beyond the text."""
    starts = line_starts(text)
    at = F.try_element_at(starts, line.cast("int")) + col
    return F.when((line >= 1) & (at <= F.length(text)), at)


def position_of(text: Column, offset: Column) -> Column:
    """(line, col), 1-based and 0-based, of an offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    lines = F.split(before, "\n")
    return F.when((offset >= 0) & (offset <= F.length(text)), F.struct(F.size(lines).alias("line"), F.length(F.element_at(lines, -1)).alias("col")))


def usage_flags(symbols: DataFrame, mapped: DataFrame, queried: DataFrame, failed: DataFrame, references: DataFrame) -> DataFrame:
    """(id, mapped, queried, failed, skipped, referenced) of each symbol; skipped is neither failed nor queried, modules aside."""
    flag = lambda t, name: t.select("id").distinct().withColumn(name, F.lit(True))
    out = symbols
    for t, name in ((mapped, "mapped"), (queried, "queried"), (failed, "failed"), (references.select(F.col("target").alias("id")), "referenced")):
        out = out.join(flag(t, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("skipped", ~F.col("failed") & ~F.col("queried") & (F.col("kind") != "Module"))


def retained_references(references: DataFrame, retained: DataFrame) -> DataFrame:
    """Targets that a retained owner refers to."""
    return references.join(retained.select(F.col("id").alias("owner")), "owner", "left_semi").select("target").distinct()
