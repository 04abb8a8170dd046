"""Referential integrity of a workspace's tables (§2.9). Every finding is an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(rows: DataFrame, code: str, message: Column, path: Column) -> DataFrame:
    return rows.select(F.lit("error").alias("level"), F.lit(code).alias("code"), message.alias("message"), path.cast("string").alias("path"))


def missing(rows: DataFrame, key: str, present: DataFrame, code: str, noun: str) -> DataFrame:
    """Rows whose key has no counterpart; a null key has none."""
    lost = rows.join(present.select(key).distinct(), key, "left_anti")
    return finding(lost, code, F.concat(F.lit(f"{noun} "), F.coalesce(F.col(key).cast("string"), F.lit("?")), F.lit(" is missing")), F.col(key))


def duplicated(rows: DataFrame, keys: list[str], code: str, noun: str) -> DataFrame:
    """Keys of more than one row, nulls aside."""
    named = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return finding(named, code, F.concat(F.lit(f"{noun} "), text, F.lit(" occurs "), F.col("_n").cast("string"), F.lit(" times")), text)


def null_field(rows: DataFrame, field: str, where: str, code: str, noun: str) -> DataFrame:
    lost = rows.filter(F.col(field).isNull() | (F.col(field).cast("string") == ""))
    return finding(lost, code, F.concat(F.lit(f"{noun} without {field} in "), F.coalesce(F.col(where).cast("string"), F.lit("?"))), F.col(where))


def candidate_sources(targets: DataFrame, files: DataFrame) -> DataFrame:
    """missing-target-source and ambiguous-target-source for targets (package, kind, name, candidates)."""
    options = targets.withColumn("_t", F.struct("package", "kind", "name")).select("_t", F.explode_outer("candidates").alias("path"))
    there = files.select("path").distinct().withColumn("_have", F.lit(True))
    n = options.join(there, "path", "left").groupBy("_t").agg(F.count("_have").alias("_n"))
    name = F.concat_ws("/", F.col("_t.package"), F.col("_t.kind"), F.col("_t.name"))
    return finding(n.filter("_n = 0"), "missing-target-source", F.concat(F.lit("no source for "), name), name).unionByName(
        finding(n.filter("_n > 1"), "ambiguous-target-source", F.concat(F.lit("several sources for "), name), name)
    )


def statuses(rows: DataFrame, column: str, bad: dict[str, str], path: str) -> DataFrame:
    """One finding per row whose status is a key of `bad`; a file reported by two walks is reported twice."""
    code = F.create_map(*[F.lit(x) for kv in bad.items() for x in kv])[F.col(column)]
    hit = rows.filter(F.col(column).isin(list(bad)))
    return hit.select(F.lit("error").alias("level"), code.alias("code"), F.concat_ws(": ", F.col(path), F.col(column)).alias("message"), F.col(path).cast("string").alias("path"))


def workspace_findings(t: dict[str, DataFrame]) -> DataFrame:
    """All checks over tables: workspace(manifest), members(package, manifest, entry, build_script),
    manifests(manifest, status), metadata(manifest, status), files(path), rust_files(path, status),
    targets(package, kind, name, candidates), dependencies(package, path), modules(path, module, candidates).
    """
    files = t["files"]
    at = lambda name: files.select(F.col("path").alias(name))
    named = t["targets"].filter(F.col("name").isNotNull())
    lost_modules = t["modules"].join(
        t["modules"].select("path", "module", F.explode("candidates").alias("_c")).join(files.select(F.col("path").alias("_c")), "_c", "left_semi").select("path", "module"),
        ["path", "module"],
        "left_anti",
    )
    local = t["dependencies"].filter(F.col("path").isNotNull())
    found = [
        missing(t["workspace"], "manifest", at("manifest"), "missing-workspace-manifest", "workspace manifest"),
        missing(t["members"], "manifest", at("manifest"), "missing-package-manifest", "package manifest"),
        missing(t["members"].filter("entry is not null"), "entry", at("entry"), "missing-package-entry", "package entry"),
        missing(t["members"].filter("build_script is not null"), "build_script", at("build_script"), "missing-build-script", "build script"),
        missing(local, "path", files, "missing-path-dependency", "path dependency"),
        candidate_sources(named, files),
        duplicated(named, ["package", "kind", "name"], "duplicate-target-name", "target"),
        null_field(t["targets"], "name", "package", "missing-target-name", "target"),
        finding(lost_modules, "missing-module-file", F.concat(F.lit("no file for module "), F.col("module")), F.col("path")),
        statuses(t["manifests"], "status", {"unreadable": "unreadable-manifest", "syntax": "manifest-syntax-error"}, "manifest"),
        statuses(t["metadata"], "status", {"failed": "cargo-metadata-failed", "unavailable": "cargo-metadata-unavailable"}, "manifest"),
        statuses(t["rust_files"], "status", {"unreadable": "unreadable-rust-file", "syntax": "rust-syntax-error"}, "path"),
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


def counters(t: dict[str, DataFrame]) -> DataFrame:
    """One row of counts; a dependency inherited from the workspace counts as neither local nor external."""
    d = t["dependencies"]
    n = lambda df, name, c=F.count("*"): df.agg(c.alias(name))
    rows = [
        n(t["members"], "packages"),
        n(t["rust_files"], "rust_files", F.count_distinct("path")),
        n(d.filter(~F.coalesce("workspace", F.lit(False)) & F.col("path").isNotNull()), "local_path_dependencies"),
        n(d.filter(~F.coalesce("workspace", F.lit(False)) & F.col("path").isNull()), "external_dependencies"),
        n(t["members"].filter("build_script is not null"), "build_scripts"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # five single rows
