"""Names to symbols (OP-03, OP-11 to OP-19, OP-28, OP-28b, OP-31, §2.15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.functions.ident import aliased, joined, normalized, sorted_distinct
from graftwork.operators.closure import first_by_rank, reach, resolve_chain

TYPE_KINDS = ("Struct", "Enum", "Union", "Type", "Trait")


def last_wins(rows: DataFrame, key: str = "id", ordinal: str = "ord") -> DataFrame:
    """One row per id: the last written."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), ordinal).alias("_r")).select("_r.*")


def type_items(items: DataFrame) -> DataFrame:
    """(package, path) of type-like items."""
    return items.filter(F.col("kind").isin(*TYPE_KINDS)).select("package", F.concat("module_path", F.array("name")).alias("path")).distinct()


def registered_callables(functions: DataFrame) -> DataFrame:
    """Functions and impl members whose type is a path; default methods of traits aren't registered."""
    in_impl = F.col("container") == "impl"
    return functions.filter((F.col("container") == "module") | (in_impl & F.coalesce(F.col("self_is_path"), F.lit(False))))


def methods_by_receiver(methods: DataFrame) -> DataFrame:
    """(package, type_path, method, ids): sorted candidates for a receiver's method."""
    return methods.groupBy("package", "type_path", "method").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def receivers_with_methods(methods: DataFrame) -> DataFrame:
    return methods.select("package", "type_path").distinct()


def module_files(files: DataFrame) -> DataFrame:
    """(package, module_path, path): a module's file, the first path if there are several."""
    return files.groupBy("package", "module_path").agg(F.min("path").alias("path"))


def inherited_aliases(aliases: DataFrame, globs: DataFrame) -> DataFrame:
    """Own aliases, and the parent module's where a module globs `super::*`; own ones win."""
    child = globs.filter((F.size("prefix") == 1) & (F.col("prefix")[0] == "super") & (F.size("module_path") > 0))
    child = child.select("package", F.col("module_path").alias("_m"), F.slice("module_path", F.lit(1), F.size("module_path") - 1).alias("module_path")).distinct()
    from_parent = child.join(aliases, ["package", "module_path"]).select("package", F.col("_m").alias("module_path"), "name", "target")
    return aliases.unionByName(from_parent.join(aliases, ["package", "module_path", "name"], "left_anti"))


def normalise_paths(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `resolved`: the first segment's alias applied once, then crate, self or super."""
    keyed = paths.withColumn("name", F.try_element_at("segments", F.lit(1)))
    joined_ = keyed.join(aliases, ["package", "module_path", "name"], "left")
    return joined_.select(*paths.columns, normalized(F.col("module_path"), aliased(F.col("segments"), F.col("target"))).alias("resolved"))


def canonical_types(wanted: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, canonical): the first of: the path itself, its re-export, then the same below each enclosing module,
    the deepest first; the path unchanged when nothing fits.

    wanted: (id, package, module_path, path).
    """
    types = type_items(items).select(joined(F.concat(F.array("package"), "path")).alias("path"))
    links = aliases.select(joined(F.concat(F.array("package"), "module_path", F.array("name"))).alias("path"), joined(F.concat(F.array("package"), "target")).alias("target"))
    depths = F.sequence(F.lit(0), F.size("module_path"))
    tries = wanted.select("id", "package", "path", "module_path", F.explode(depths).alias("up"))
    prefix = F.when(F.col("up") == 0, F.array().cast("array<string>")).otherwise(F.slice("module_path", F.lit(1), F.size("module_path") - F.col("up") + 1))
    tries = tries.select("id", "up", joined(F.concat(F.array("package"), prefix, "path")).alias("start"))
    chained = resolve_chain(tries.select("start").distinct(), links, types)
    found = tries.join(chained.filter("target is not null"), "start").withColumn("rank", F.col("up") * 2 + F.when(F.col("start") == F.col("target"), 0).otherwise(1))
    best = first_by_rank(found, "id", "rank").select("id", "target")
    return wanted.join(best, "id", "left").select("id", F.coalesce("target", joined(F.concat(F.array("package"), "path"))).alias("canonical"))


def type_inputs(paths: Column) -> Column:
    """Sorted distinct path types among generic arguments."""
    return sorted_distinct(F.transform(paths, joined))


def entry_targets(targets: DataFrame) -> DataFrame:
    """One entry target per package: marked, then library or macro, then a binary at src/main.rs, then any binary,
    then any that isn't a test, bench or example; ties go to the source path.
    """
    kind = lambda *k: F.arrays_overlap("kind", F.array(*[F.lit(x) for x in k]))
    rank = (
        F.when(F.col("marked"), 0)
        .when(kind("lib", "proc-macro"), 1)
        .when(kind("bin") & F.col("src_path").endswith("src/main.rs"), 2)
        .when(kind("bin"), 3)
        .when(~kind("test", "bench", "example"), 4)
    )
    return first_by_rank(targets.withColumn("rank", rank).filter("rank is not null"), "package", "rank", "src_path")


def with_manifest_entries(targets: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(package, src_path, rank): the entry of every package; without a fitting target the manifest's `lib.path`, then
    `src/lib.rs` where that is a file, then `src/main.rs`.

    manifests: (package, root, lib_path).
    """
    own = entry_targets(targets).select("package", "src_path", "rank")
    rest = manifests.join(own.select("package"), "package", "left_anti")
    lib = F.concat("root", F.lit("/src/lib.rs"))
    have = rest.withColumn("path", lib).join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    path = F.when(F.col("lib_path").isNotNull(), F.concat("root", F.lit("/"), "lib_path")).when(F.col("_there"), lib).otherwise(F.concat("root", F.lit("/src/main.rs")))
    rank = F.when(F.col("lib_path").isNotNull(), 5).when(F.col("_there"), 6).otherwise(7)
    return own.unionByName(have.select("package", path.alias("src_path"), rank.alias("rank")))


def marked_sources(parsed: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """(path) of files with an item that the attribute marks; a file that can't be parsed is searched line by line."""
    named = rf"^(?:\w+\s*::\s*)*{marker}\b"
    by_item = parsed.filter("status = 'ok'").filter(F.exists("items", lambda i: F.exists(i["attrs"], lambda a: a.rlike(named)))).select("path")
    broken = parsed.filter("status <> 'ok'").select("path").join(files, "path")
    return by_item.unionByName(broken.filter(F.col("text").rlike(rf"(?m)^[ \t]*#\[ ?{marker}")).select("path"))


def marked_targets(targets: DataFrame, modules: DataFrame, marked: DataFrame) -> DataFrame:
    """Targets (package, name, src_path) with `marked`: whether a file that the entry reaches through modules (path, child) is marked."""
    roots = targets.select(F.col("src_path").alias("entry"), F.col("src_path").alias("node")).distinct()
    seen = reach(modules, roots, src="path", dst="child", by=("entry",))
    hit = seen.join(marked.select(F.col("path").alias("node")), "node", "left_semi").select(F.col("entry").alias("src_path")).distinct().withColumn("marked", F.lit(True))
    return targets.join(hit, "src_path", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def dependency_rows(raw: DataFrame, entries: DataFrame) -> DataFrame:
    """(package, alias, dep_package), sorted distinct; development ones only for test, bench and example entries."""
    dev_ok = entries.select("package", F.arrays_overlap("kind", F.array(F.lit("example"), F.lit("test"), F.lit("bench"))).alias("_dev"))
    kept = raw.join(dev_ok, "package", "left").filter((F.coalesce("kind", F.lit("normal")) != "dev") | F.coalesce("_dev", F.lit(False)))
    return kept.select("package", F.coalesce("rename", "name").alias("alias"), F.col("name").alias("dep_package")).distinct().orderBy("package", "alias", "dep_package")


def required_features(targets: DataFrame, tables: DataFrame) -> DataFrame:
    """Targets with the sorted distinct features that their table asks for."""
    found = tables.groupBy("package", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("required_features"))
    empty = F.array().cast("array<string>")
    return targets.join(found, (targets["package"] == found["package"]) & (targets["src_path"] == found["path"]), "left").drop(found["package"], found["path"]).withColumn("required_features", F.coalesce("required_features", empty))


def single_marked(targets: DataFrame) -> DataFrame:
    """(package, target) of packages with a marked target; more than one is an error when the row is read."""
    n = targets.filter("marked").groupBy("package").agg(F.count("*").alias("_n"), F.min("name").alias("target"))
    check = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several marked targets in "), F.col("package")))).otherwise(F.col("target"))
    return n.select("package", check.alias("target"))


def unresolved_method() -> Column:
    """STRUCT<category, reason> of a row (in_macro, primitive_turbofish, external_anchor, external_receiver, project_method)."""
    out = lambda c, r: F.struct(F.lit(c).alias("category"), F.lit(r).alias("reason"))
    return (
        F.when(F.col("in_macro"), out("macro_blocked", "unresolved_method_inside_macro_or_attribute_context"))
        .when(F.col("primitive_turbofish"), out("benign", "unresolved_method_has_primitive_turbofish"))
        .when(F.col("external_anchor"), out("benign", "unresolved_method_receiver_has_external_anchor"))
        .when(F.col("external_receiver"), out("benign", "unresolved_method_looks_like_common_external_receiver"))
        .when(F.col("project_method"), out("dependency_risk", "unresolved_method_name_matches_project_method"))
        .otherwise(out("benign", "unresolved_method_has_no_project_local_method_match"))
    )


def unresolved_path() -> Column:
    """STRUCT<category, reason> of a row (in_macro, root, external_root, imported, derived_default, project_local)."""
    out = lambda c, r: F.struct(F.lit(c).alias("category"), F.lit(r).alias("reason"))
    return (
        F.when(F.col("in_macro"), out("macro_blocked", "unresolved_path_inside_macro_or_attribute_context"))
        .when(F.col("root").isin("std", "core", "alloc"), out("benign", "unresolved_path_has_external_root"))
        .when(F.col("external_root"), out("benign", "unresolved_path_has_external_dependency_root"))
        .when(F.col("imported"), out("benign", "unresolved_path_has_retained_external_import"))
        .when(F.col("derived_default"), out("benign", "unresolved_path_is_derived_default_call"))
        .when(F.col("project_local"), out("dependency_risk", "unresolved_path_anchor_matches_project_local_identifier"))
        .otherwise(out("benign", "unresolved_path_has_no_project_local_identifier"))
    )


def peeled_receiver(text: Column, rounds: int = 8) -> Column:
    """A receiver expression without outer parentheses, references, `?`, `.await`, and trailing calls that return their receiver."""
    out = F.trim(text)
    for _ in range(rounds):
        out = F.trim(F.regexp_replace(out, r"^\((.*)\)$|^(?:&(?:mut\s+)?|\*)(.+)$", "$1$2"))
        out = F.trim(F.regexp_replace(out, r"(?:\?|\.await|\.(?:clone|as_ref|as_mut|borrow|borrow_mut|unwrap|iter|into_iter|to_owned|lock)\(\))$", ""))
    return out


def edges_by_path(references: DataFrame, symbols: DataFrame, kind: str = "direct_path") -> DataFrame:
    """(owner, dep, kind) where a reference's resolved path is a symbol's."""
    hit = references.join(symbols.select("package", F.col("path").alias("resolved"), F.col("id").alias("dep")), ["package", "resolved"])
    return hit.select("owner", "dep", F.lit(kind).alias("kind")).filter("owner <> dep").distinct()


def edges_by_method(calls: DataFrame, index: DataFrame) -> DataFrame:
    """(owner, dep, kind) of calls with a known receiver type; a call without one keeps a single unambiguous match.

    Repeated calls go before they meet their candidates. An id under one
    receiver alone can't come twice for an owner then, so only ids that several
    receivers share are made distinct after the explosion.
    """
    asked = calls.filter("type_path is not null").select("owner", "package", "type_path", "method").distinct()
    receivers = index.select("package", "type_path", "method", F.explode("ids").alias("id"))
    shared = receivers.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id", F.lit(True).alias("_shared"))
    split = receivers.join(shared, "id", "left").groupBy("package", "type_path", "method").agg(
        F.collect_list(F.when(F.col("_shared").isNull(), F.col("id"))).alias("_own"), F.collect_list(F.when(F.col("_shared"), F.col("id"))).alias("_shared")
    )
    met = asked.join(split, ["package", "type_path", "method"])
    own, common = met.select("owner", F.explode("_own").alias("dep")), met.select("owner", F.explode("_shared").alias("dep")).distinct()
    typed = own.unionByName(common).select("owner", "dep", F.lit("receiver_method").alias("kind"))
    return typed.filter("owner <> dep").unionByName(single_name_edges(calls, index))


def single_name_edges(calls: DataFrame, index: DataFrame) -> DataFrame:
    """(owner, dep, kind) of calls without a receiver type whose method has one candidate."""
    ends = index.filter(F.size("ids") > 0).groupBy("package", "method").agg(F.min(F.array_min("ids")).alias("_lo"), F.max(F.array_max("ids")).alias("_hi"))
    bare = calls.filter("type_path is null").select("owner", "package", "method").distinct().join(ends.filter("_lo = _hi"), ["package", "method"])
    return bare.select("owner", F.col("_lo").alias("dep"), F.lit("single_name").alias("kind")).filter("owner <> dep").distinct()


def method_edge_counts(calls: DataFrame, index: DataFrame) -> DataFrame:
    """(owner, n, total): the number of `edges_by_method`'s rows of each owner and the sum of their numeric ids, typed calls counted by receiver."""
    from graftwork.operators.edges import key_counts

    keys = ["package", "type_path", "method"]
    asked = calls.filter("type_path is not null").select("owner", *keys).distinct()
    typed = key_counts([(asked, index.select(*keys, F.explode("ids").alias("id")), keys)])
    single = single_name_edges(calls, index).select("owner", F.lit(1).cast("bigint").alias("n"), F.col("dep").cast("bigint").alias("total"))
    return typed.unionByName(single).groupBy("owner").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
