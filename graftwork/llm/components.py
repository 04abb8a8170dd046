"""Connected components by alternating large and small stars, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (u, v) with u > v.

    Minima are pre-aggregated, so a node with a third of all edges costs its
    joins a skewed key, which adaptive execution splits, and never a list.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, root) for every id in links (a, b): root is the smallest id that it reaches."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = scratch.save(pairs, f"{name}-0")
    mark = None
    for k in range(1, MAX_ROUNDS):
        edges = scratch.save(_star(edges), f"{name}-{k}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"{name}-{k - 1}")
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def joined(scratch: Scratch, roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(id, root) after more links: only these, between roots, are worked on."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    new = components(scratch, between, name)
    moved = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(new.join(roots.select("id"), "id", "left_anti"))
