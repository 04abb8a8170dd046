"""Rollups, pivots and contracts (OP-40 to OP-42, OP-51 to OP-56, OP-59 to OP-59b, §2.17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURFACES = (
    *(f"{state}_{kind}" for state in ("used", "reachable", "prunable", "blocked_by_unknown", "rendered") for kind in ("callables", "items")),
    *(f"rendered_{kind}" for kind in ("assoc_items", "members")),
    *(f"{kind}_surfaces" for kind in ("macro", "unknown")),
)


def pivot_with_seeds(rows: DataFrame, seeds: DataFrame, key: str, tag: str, tags: tuple[str, ...], unknown: str | None = None) -> DataFrame:
    """Counts of each tag per key, zero where there are none; seeds appear even without rows, and null keys as `unknown`.

    The tags are given, so no job looks for them, and counts combine before the shuffle.
    """
    named = rows.withColumn(key, F.coalesce(key, F.lit(unknown))) if unknown is not None else rows
    counted = named.groupBy(key).agg(*[F.count_if(F.col(tag) == t).alias(t) for t in tags])
    return seeds.select(key).distinct().join(counted, key, "full").fillna(0, subset=list(tags))


def surface_audit(surfaces: DataFrame, packages: DataFrame, roots: DataFrame) -> DataFrame:
    """14 counters a package from rows (package, surface)."""
    return pivot_with_seeds(surfaces, packages.select("package").unionByName(roots.select("package")), "package", "surface", SURFACES, "<unknown-package>")


def per_file(rows: DataFrame, file: str, flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(file).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def contract(decisions: DataFrame, used: str = "used", blocked: str = "blocked_by_unknown", by: tuple[str, ...] = ()) -> DataFrame:
    """Rendered symbols by decision: used, blocked, anything else (null too) invalid; any invalid one fails."""
    d = F.col("decision")
    counted = decisions.groupBy(*by).agg(F.count_if(d == used).alias("used"), F.count_if(d == blocked).alias("blocked_by_unknown"), F.count_if(d.isNull() | ~d.isin(used, blocked)).alias("invalid"))
    return counted.withColumn("passed", F.col("invalid") == 0)


def last_by(rows: DataFrame, key: str, value: str, ordinal: Column | str, keys: DataFrame | None = None, missing: str = "missing") -> DataFrame:
    """The value at the greatest ordinal per key; a sentinel for keys without a row."""
    last = rows.groupBy(key).agg(F.max_by(value, ordinal).alias(value))
    return last if keys is None else keys.select(key).distinct().join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def semantic_rollup(files: DataFrame) -> DataFrame:
    """File counters summed over the workspace and over selected roots; unresolved never falls below zero."""
    names = ("method_calls", "queried_method_calls", "resolved_method_calls", "paths", "queried_paths", "resolved_paths")
    flags = ("analyzed", "failed", "skipped")
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names] + [F.count("*").alias("source_files")] + [F.count_if(F.col("state") == f).alias(f"{f}_files") for f in flags]
    root = F.col("is_root")
    sums += [F.coalesce(F.sum(F.when(root, F.col(n))), F.lit(0)).alias(f"selected_root_{n}") for n in names]
    sums += [F.count_if(root).alias("selected_root_source_files")] + [F.count_if(root & (F.col("state") == f)).alias(f"selected_root_{f}_files") for f in flags]
    out = files.agg(*sums)
    for p in ("", "selected_root_"):
        for kind in ("method_calls", "paths"):
            q, r = F.col(f"{p}queried_{kind}"), F.col(f"{p}resolved_{kind}")
            out = out.withColumn(f"{p}unresolved_{kind}", F.greatest(q - r, F.lit(0))).withColumn(f"{p}unqueried_{kind}", F.greatest(F.col(f"{p}{kind}") - q, F.lit(0)))
    return out


def evidence_sum(rows: DataFrame, counters: list[str], details: list[str], by: list[str]) -> DataFrame:
    """Field-wise sums, and details concatenated in the order of `ord`."""
    def concatenated(name: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", name))), lambda x: x[name])).alias(name)

    packed = [concatenated(d) for d in details]
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], *packed)


def skipped_queries(all_: DataFrame, failed: DataFrame, skipped: DataFrame, queried: DataFrame) -> DataFrame:
    """What was neither failed, skipped nor queried, modules aside."""
    out = all_.filter("kind <> 'Module'")
    for t in (failed, skipped, queried):
        out = out.join(t.select("id").distinct(), "id", "left_anti")
    return out


def axis_coverage(rows: DataFrame, axis: str, expected: DataFrame) -> DataFrame:
    """(axis, n): every expected value with its count, zero where it is not covered."""
    return expected.select(axis).distinct().join(rows.groupBy(axis).agg(F.count("*").alias("n")), axis, "left").fillna(0, subset=["n"])


PROOFS = ("cfg_inactive", "source_file_pruned", "rendered_absent", "structural_pruned", "unmapped", "failed_query")


def usage_proof(symbols: DataFrame) -> DataFrame:
    """Prunable symbols by the first proof that fits, out of boolean columns; the last two, and none at all, leave a debt."""
    bucket = F.when(F.lit(False), "")
    for name in PROOFS:
        bucket = bucket.when(F.coalesce(name, F.lit(False)), name)
    marked = symbols.withColumn("bucket", bucket.when(F.coalesce("proven", F.lit(False)), "proven").otherwise("unproven"))
    debt = F.col("bucket").isin("unmapped", "failed_query", "unproven")
    return marked.groupBy("kind").agg(F.count("*").alias("required"), F.count_if(~debt).alias("proven"), F.count_if(debt).alias("unproven"), *[F.count_if(F.col("bucket") == p).alias(p) for p in PROOFS])


def keyed_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct `key=value` texts; a row without a value gives the key."""
    text = F.when(F.col(value).isNull(), F.col(key)).otherwise(F.concat(key, F.lit("="), F.col(value).cast("string")))
    return rows.agg(F.array_sort(F.collect_set(text)).alias("entries"))
