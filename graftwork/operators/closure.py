"""Reachability and other fixpoints over edge tables (OP-15, OP-34 to OP-39).

Call graphs have cycles, on which Spark's recursive CTE doesn't end; these are
semi-naive loops. Each round joins only the new frontier with the edges and
anti-joins what was seen. Every round's table is written to the shared folder.
The edges are also kept on the executors, partitioned and sorted by their
start, so that a round shuffles its frontier and the ids seen so far, and never
the edges; an executor that is lost reads its share from the folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftwork.operators.staging import Rounds

MAX_ROUNDS = 10_000
#: Layers of seen nodes before they are written as one table.
FANOUT = 8


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst", node: str = "node", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, depth): what the roots reach, themselves included, at the least number of edges.

    With `by` (say a root id) many closures run together, one per value. Null
    nodes and edges to or from null are ignored; duplicate edges and roots
    change nothing.
    """
    spark = edges.sparkSession
    stage = Rounds(spark, "reach")
    keys = [*by, node]
    steps = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("_from"), F.col(dst).alias("_to")).distinct()
    # kept on the executors by their start, so that no round shuffles them again; their file stands behind them
    steps = stage.save(steps).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_from").sortWithinPartitions("_from").persist()
    frontier = stage.save(roots.filter(F.col(node).isNotNull()).select(*keys).distinct())
    layers, seen = [frontier.withColumn("depth", F.lit(0))], frontier
    for depth in range(1, MAX_ROUNDS):
        if max_depth is not None and depth > max_depth:
            break
        new = frontier.join(steps, frontier[node] == steps["_from"]).select(*by, F.col("_to").alias(node)).distinct()
        frontier = stage.save(new.join(seen, keys, "left_anti"))
        if frontier.isEmpty():
            break
        layers.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if depth % FANOUT == 0:
            seen = stage.save(seen)
    else:
        raise RuntimeError(f"the closure did not end in {MAX_ROUNDS} rounds")
    steps.unpersist()
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def unreachable(nodes: DataFrame, reached: DataFrame, node: str = "node") -> DataFrame:
    return nodes.join(reached.select(node).distinct(), node, "left_anti")


def split_reached(reached: DataFrame, callables: DataFrame, items: DataFrame, node: str = "node") -> DataFrame:
    """(id, kind): reached callables and items, and both kinds of unreached ones as dead."""
    own = reached.select(F.col(node).alias("id")).distinct().withColumn("_hit", F.lit(True))
    every = callables.select("id", F.lit("callable").alias("kind")).unionByName(items.select("id", F.lit("item").alias("kind")))
    return every.join(own, "id", "left").select("id", "kind", F.coalesce("_hit", F.lit(False)).alias("reachable"))


def package_closure(dependencies: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Packages reached over dependencies between members; a root that is no member still counts."""
    inside = dependencies.join(members.select(F.col("package").alias("dep_package")), "dep_package", "left_semi")
    return reach(inside, roots, src="package", dst="dep_package", node="package").select("package")


def call_edges(calls: DataFrame, retained: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((owner, dep) hints, one row of counters) of calls (owner, target, in_workspace) followed from retained owners.

    Self-edges are dropped, targets outside the workspace ignored, targets
    inside that the index lacks counted as unmapped. `edges` counts
    occurrences, the hints are distinct.
    """
    usable = calls.filter("owner <> target")
    mapped = usable.join(index.select(F.col("id").alias("target")), "target", "left_semi").select("owner", F.col("target").alias("dep"))
    owners = reach(mapped, retained, src="owner", dst="dep", node="id").select(F.col("id").alias("owner"))
    scanned = calls.join(owners, "owner", "left_semi")
    known = index.select(F.col("id").alias("target"), F.lit(True).alias("_known"))
    judged = scanned.join(known, "target", "left")
    counters = judged.agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("_known") & (F.col("owner") != F.col("target"))).alias("edges"),
        F.count_if(F.col("_known").isNull() & F.col("in_workspace")).alias("unmapped"),
    )
    return mapped.join(owners, "owner", "left_semi").distinct(), counters


def union_edges(*tables: DataFrame) -> DataFrame:
    """One distinct edge table from several producers."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.distinct()


def resolve_chain(starts: DataFrame, aliases: DataFrame, types: DataFrame) -> DataFrame:
    """(start, target): follow aliases (path -> target) until a type-like path; a cycle or dead end gives null.

    Pointer jumping: after k rounds every path knows what lies 2^k aliases on,
    or its type. Paths that are open after a round in which none has ended run
    in cycles. Of several targets of a path the least counts.
    """
    stage = Rounds(starts.sparkSession, "chain")
    ends = types.select(F.col("path").alias("to")).distinct().withColumn("_type", F.lit(True))
    first = aliases.filter("path is not null").groupBy(F.col("path").alias("at")).agg(F.min("target").alias("to"))
    first = first.join(ends.withColumnRenamed("to", "at"), "at", "left_anti").filter("to is not null")
    jump = stage.save(first.join(ends, "to", "left").select("at", "to", F.coalesce("_type", F.lit(False)).alias("done")))
    open_ = jump.filter("not done").count()
    while open_:
        onward = jump.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        moved = jump.filter("not done").join(onward, "to").select("at", F.col("_to").alias("to"), F.col("_done").alias("done"))
        jump = stage.save(jump.filter("done").unionByName(moved))
        stage.drop(stage.n - 1)
        left = jump.filter("not done").count()
        if left == open_:
            break
        open_ = left
    found = jump.filter("done").select(F.col("at").alias("start"), F.col("to").alias("target"))
    own = ends.select(F.col("to").alias("start"), F.col("to").alias("target"))
    return starts.select("start").join(own.unionByName(found), "start", "left")


def blocked_by_unknown(candidates: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unreached candidates that unknown evidence retains, and what these need in turn.

    `evidence` has (id, mapped, referenced, failed, mentioned): a candidate is
    promoted when it is unmapped but referenced, its query failed, or a scoped
    unknown mentions it. Promotion goes on along edges between candidates.
    """
    seeds = evidence.filter((~F.col("mapped") & F.col("referenced")) | F.col("failed") | F.col("mentioned")).join(candidates, "id", "left_semi").select("id")
    inside = edges.join(candidates.select(F.col("id").alias("dep")), "dep", "left_semi")
    return reach(inside, seeds, src="owner", dst="dep", node="id").select("id", (F.col("depth") == 0).alias("direct"))


def module_tree(declared: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, module_path, depth) of each file that entries reach through module declarations.

    declared has (path, module, candidates), candidates in the order of
    preference; a file is visited once, under the first module path that
    reaches it.
    """
    stage = Rounds(declared.sparkSession, "modules")
    have = files.select(F.col("path").alias("to")).distinct()
    tries = declared.select("path", "module", F.posexplode("candidates").alias("pos", "to")).join(have, "to", "left_semi")
    links = stage.save(tries.groupBy("path", "module").agg(F.min_by("to", "pos").alias("to")))
    frontier = stage.save(entries.select("path", F.array().cast("array<string>").alias("module_path")).dropDuplicates(["path"]))
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, MAX_ROUNDS):
        new = frontier.join(links, "path").select(F.col("to").alias("path"), F.concat("module_path", F.array("module")).alias("module_path"))
        first = new.groupBy("path").agg(F.min("module_path").alias("module_path"))
        frontier = stage.save(first.join(seen, "path", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    raise RuntimeError("the module tree did not end")


def missing_modules(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Declarations none of whose candidate files exists."""
    have = files.select(F.col("path").alias("to")).distinct()
    found = declared.select("path", "module", F.explode("candidates").alias("to")).join(have, "to", "left_semi")
    return declared.join(found, ["path", "module"], "left_anti")


def first_success(candidates: DataFrame, key: str, priority: str, result: str) -> DataFrame:
    """Per key the first non-null result by priority; null where none succeeds."""
    best = candidates.filter(F.col(result).isNotNull()).groupBy(key).agg(F.min_by(result, priority).alias(result))
    return candidates.select(key).distinct().join(best, key, "left")


def first_by_rank(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a total order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
