"""Embedding near-dedup by NN-descent.

A neighbour graph starts from a few sorted random-hyperplane orders, in which
blocks of consecutive vectors are compared, and is refined by
neighbours-of-neighbours joins: the neighbours of each vector, forward and
reverse, are compared with each other, and a pair enters the lists that it
improves. A list that is saturated, its last entry still near the threshold,
may grow up to `MAX_LIST`; what it has no room for is found by bridging: near
pairs give groups, and the vectors of groups are searched again with lists that
hold vectors of other groups only, until a search joins no groups any more.
Half of its orders thin out long runs of one group, so that large groups meet.
An audit compares a bounded set of vectors with all rows and, below the target
recall, sends the graph through more rounds; if that doesn't help, it raises.

Search runs on half-precision vectors. Pairs near the threshold give groups;
inside a group every pair of rows is then compared in double precision, in
blocks, which count links and emit a spanning forest, never the pairs. Rows
within half the threshold's angle of their group's first row are all linked
with each other, so copies of one thing are counted without comparing them.

Defined results: a vector that is null, zero, or holds a null or non-finite
component links with nothing, as does one whose length isn't the table's
commonest (the longer on a tie). Equal vectors, told by a 128-bit cryptographic
digest of their unit vectors, are one class and are linked;
repeated rows count as rows of their own. Ids order components (nulls last);
other columns, labels among them, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch
from graftwork.llm.components import components, joined
from graftwork.llm.neardup import groups

LIST = 6
MAX_LIST = 24
TABLES = 4
BLOCK = 512
CHUNK = 1024
#: Rows of one group that a thinned order keeps in a buffer of two blocks.
THIN = 64
ROUNDS = 3
#: Stop refining when a round changes less than this share of the lists' entries.
SETTLED = 0.01
AUDIT = 256
RECALL = 0.99
ATTEMPTS = 4
#: Half precision is off by less than this.
MARGIN = 0.01


def unit_vectors(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """(row, id, h, v, half): the unit vector in double and half precision with its digest, null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, full, half = [], [], []
            for x in batch.column("x").to_pylist():
                v = None
                if x is not None and len(x) == dim and None not in x:
                    v = np.array(x, dtype=np.float64)
                    big = np.abs(v).max() if dim else 0.0
                    v = v / big if np.isfinite(big) and big > 0 else None
                if v is None or not np.isfinite(v).all():
                    name.append(None)
                    full.append(None)
                    half.append(None)
                    continue
                v = v / math.sqrt(float(v @ v)) + 0.0  # no negative zeros, so that equal vectors have equal bytes
                full.append(v.tobytes())
                name.append(hashlib.blake2b(full[-1], digest_size=16).digest())
                half.append(v.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *(pa.array(c, pa.binary()) for c in (name, full, half))], names=["row", "id", "h", "v", "half"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"row bigint, id {kind}, h binary, v binary, half binary")


def stacked(column, dtype) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)


def halves(column) -> np.ndarray:
    return stacked(column, np.float16).astype(np.float32)


def ordered(reps: DataFrame, seed: int, dim: int) -> DataFrame:
    """Vectors in the order of 30 hyperplane signs, then of one projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng([4177, seed]).standard_normal((dim, 31)).astype(np.float32)
        for batch in batches:
            p = halves(batch.column("half")) @ planes
            code = ((p[:, :30] > 0).astype(np.int64) << np.arange(30)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(p[:, 30].astype(np.float64)), *batch.columns], names=["code", "place", "rep", "root", "half"])

    coded = reps.select("rep", "root", "half").mapInArrow(run, "code bigint, place double, rep bigint, root bigint, half binary")
    return coded.repartitionByRange("code", "place", "rep").sortWithinPartitions("code", "place", "rep")


def best_of(rep: np.ndarray, root: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """Each row's k most similar others outside its group: (u, v, sim)."""
    sims[root[:, None] == root] = -2
    k = min(k, len(rep) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(rep)), k)
    flat = top.ravel()
    other = root[rows] != root[flat]
    rows, flat = rows[other], flat[other]
    return pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(rep[flat]), pa.array(sims[rows, flat].astype(np.float64))], names=["u", "v", "sim"])


def thinned(table: pa.Table, rng: np.random.Generator) -> pa.Table:
    """At most THIN rows of each group, drawn at random, in their order."""
    root = table.column("root").to_numpy()
    mixed = rng.permutation(len(root))
    by_root = mixed[np.argsort(root[mixed], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(root[by_root]) != 0])
    nth = np.arange(len(root)) - np.repeat(starts, np.diff(np.r_[starts, len(root)]))
    return table.take(pa.array(np.sort(by_root[nth < THIN])))


def neighbours_in_blocks(rows: DataFrame, thin: bool = False, seed: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        rng = np.random.default_rng([911, seed])
        for batch in batches:
            for piece in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                held.append(piece.select(["rep", "root", "half"]))
                n += piece.num_rows
                if n >= 2 * BLOCK:
                    table = pa.Table.from_batches(held)
                    table = thinned(table, rng) if thin else table
                    whole = max(table.num_rows // BLOCK - 1, 0)  # the last block waits, so that no rest is too short
                    for i in range(whole):
                        yield compared(table.slice(i * BLOCK, BLOCK))
                    held, n = table.slice(whole * BLOCK).to_batches(), table.num_rows - whole * BLOCK
        if n > 1:
            yield compared(pa.Table.from_batches(held))

    def compared(table: pa.Table) -> pa.RecordBatch:
        x = halves(table.column("half"))
        return best_of(table.column("rep").to_numpy(), table.column("root").to_numpy(), x @ x.T, LIST)

    return rows.mapInArrow(run, "u bigint, v bigint, sim double")


def lists_of(edges: DataFrame, near: float) -> DataFrame:
    """Each vector's list: LIST entries, or up to MAX_LIST while they are near the threshold."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    ranked = best.withColumn("nth", nth).filter(F.col("nth") <= MAX_LIST)
    return ranked.filter((F.col("nth") <= LIST) | (F.col("sim") >= near)).select("u", "v", "sim", "fresh")


def refined(graph: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v, sim) found among neighbours of neighbours of different groups, where it improves a list."""
    last = graph.groupBy("u").agg(F.min("sim").alias("least"))
    nth = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("sim"), "x"))
    forward = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "sim", "fresh")
    reverse = graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "sim", "fresh")
    sides = [s.withColumn("nth", nth).filter(F.col("nth") <= LIST).drop("nth", "sim") for s in (forward, reverse)]
    joined = sides[0].unionByName(sides[1]).groupBy("w", "x").agg(F.max("fresh").alias("fresh"))
    vectors = reps.select(F.col("rep").alias("x"), "root", "half").join(last.withColumnRenamed("u", "x"), "x")
    rows = joined.join(vectors, "x").repartition("w").sortWithinPartitions("w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, held = [], [], [], 0
        for g in groups(batches, "w"):
            x, root, fresh, least = (g.column(c).to_numpy() for c in ("x", "root", "fresh", "least"))
            if len(x) < 2 or not fresh.any():
                continue
            h = halves(g.column("half"))
            i, j = np.triu_indices(len(x), 1)
            use = (fresh[i] | fresh[j]).astype(bool) & (root[i] != root[j])
            i, j = i[use], j[use]
            s = (h @ h.T)[i, j].astype(np.float64)
            for a, b in ((i, j), (j, i)):
                ok = s > least[a]
                us.append(x[a[ok]])
                vs.append(x[b[ok]])
                ss.append(s[ok])
                held += int(ok.sum())
            if held > 100_000:
                yield made(us, vs, ss)
                us, vs, ss, held = [], [], [], 0
        if held:
            yield made(us, vs, ss)

    def made(us, vs, ss) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (us, vs, ss)], names=["u", "v", "sim"])

    return rows.select("w", "x", "root", "fresh", "least", "half").mapInArrow(run, "u bigint, v bigint, sim double")


def outside(graph: DataFrame, held: DataFrame) -> DataFrame:
    """The entries between different groups."""
    of = lambda c: held.select(F.col("rep").alias(c), F.col("root").alias(f"{c}_root"))
    return graph.join(of("u"), "u").join(of("v"), "v").filter("u_root <> v_root").select("u", "v", "sim")


def descended(scratch: Scratch, held: DataFrame, graph: DataFrame, seed: int, dim: int, near: float, name: str, thin: bool = False) -> DataFrame:
    """The lists of held (rep, root, half) after one descent that starts from the entries of graph and new orders."""
    edges = graph.withColumn("fresh", F.lit(0))
    for t in range(TABLES):
        found = neighbours_in_blocks(ordered(held, seed * TABLES + t, dim), thin and t % 2 == 1, seed * TABLES + t)
        edges = edges.unionByName(found.withColumn("fresh", F.lit(1)))
    graph, old = scratch.save(lists_of(edges, near), name), name
    for k in range(ROUNDS):
        more = refined(graph, held).withColumn("fresh", F.lit(1))
        graph = scratch.save(lists_of(graph.withColumn("fresh", F.lit(0)).unionByName(more), near), f"{name}-{k}")
        scratch.drop(old)
        old = f"{name}-{k}"
        n = graph.agg(F.count("*"), F.sum("fresh")).first()
        if not n[0] or n[1] < SETTLED * n[0]:
            break
    return graph


def links_of(graph: DataFrame, near: float) -> DataFrame:
    return graph.filter(F.col("sim") >= near).select(F.col("u").alias("a"), F.col("v").alias("b"))


def bridged(scratch: Scratch, reps: DataFrame, roots: DataFrame, seed: int, dim: int, near: float, name: str) -> tuple[DataFrame, int]:
    """(groups, the next seed) after joining groups until a search finds no near pair between two of them."""
    none = scratch.spark.createDataFrame([], "u bigint, v bigint, sim double")
    while True:
        held = scratch.save(reps.select("rep", "half").join(roots.withColumnRenamed("id", "rep"), "rep"), f"{name}-held-{seed}")
        links = links_of(descended(scratch, held, none, seed, dim, near, f"{name}-{seed}", thin=True), near)
        scratch.drop(f"{name}-held-{seed}")
        seed += 1
        if links.isEmpty():
            return roots, seed
        roots = scratch.save(joined(scratch, roots, links, f"{name}-near-{seed}"), f"{name}-roots-{seed}")


def audited(spark: SparkSession, reps: DataFrame, roots: DataFrame, threshold: float) -> float:
    """The share of a bounded set of vectors' links that lie inside the groups."""
    held = reps.select("rep", "v").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "v", F.coalesce("root", "rep").alias("root"))
    # half of the set from groups, as most vectors have no link at all
    mark = F.xxhash64(F.lit(11), "rep")
    own = held.join(roots.select(F.col("id").alias("rep")), "rep", "left_semi").orderBy(mark).limit(AUDIT // 2)
    asked = own.collect() + held.orderBy(mark).limit(AUDIT // 2).collect()
    if not asked:
        return 1.0
    q = spark.sparkContext.broadcast((np.array([r.rep for r in asked]), np.array([r.root for r in asked]), np.stack([np.frombuffer(r.v) for r in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots_, vectors = q.value
        every = inside = 0
        for batch in batches:
            rep, root = (batch.column(c).to_numpy() for c in ("rep", "root"))
            linked = (stacked(batch.column("v"), np.float64) @ vectors.T >= threshold) & (rep[:, None] != ids)
            every += int(linked.sum())
            inside += int((linked & (root[:, None] == roots_)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([every]), pa.array([inside])], names=["every", "inside"])

    total = held.mapInArrow(run, "every bigint, inside bigint").agg(F.sum("every"), F.sum("inside")).first()
    return total[1] / total[0] if total[0] else 1.0


def counted(scratch: Scratch, members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((rep, n), (a, b)): rows linked with each class, and a spanning forest of the links, inside each group.

    members: (rep, root, mult, v).
    """
    pivot = members.filter("rep = root").select("root", F.col("v").alias("p"))
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = np.einsum("ij,ij->i", stacked(batch.column("v"), np.float64), stacked(batch.column("p"), np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "root", "mult", "v")), pa.array(cos >= half)], names=["rep", "root", "mult", "v", "inner"])

    rows = members.join(pivot, "root").select("rep", "root", "mult", "v", "p").mapInArrow(near, "rep bigint, root bigint, mult bigint, v binary, inner boolean")
    rows = scratch.save(rows, "inner")
    sizes = rows.groupBy("root").agg(
        F.ceil(F.count("*") / CHUNK).alias("all_"),
        F.ceil(F.count_if(~F.col("inner")) / CHUNK).alias("outer_"),
        F.sum(F.when(F.col("inner"), F.col("mult")).otherwise(0)).alias("inner_mult"),
    )
    rows = rows.join(sizes, "root")
    inner = rows.filter("inner").select("rep", (F.col("inner_mult") - F.col("mult")).alias("n"))
    stars = rows.filter("inner and rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # each chunk of outer rows meets each chunk of all rows
    spread = F.xxhash64("rep")
    left = rows.filter("not inner").withColumn("o", F.pmod(spread, F.col("outer_"))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all_") - 1)))
    right = rows.filter("outer_ > 0").withColumn("c", F.pmod(spread, F.col("all_"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outer_") - 1)))
    parts = [side.select(F.xxhash64("root", "o", "c").alias("part"), F.lit(i).alias("role"), "rep", "mult", "inner", "v") for i, side in enumerate((left, right))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "part"):
            role, rep, mult, inner_ = (g.column(c).to_numpy() for c in ("role", "rep", "mult", "inner"))
            x = stacked(g.column("v"), np.float64)
            a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(a) or not len(b):
                continue
            linked = (x[a] @ x[b].T >= threshold) & (rep[a][:, None] != rep[b])
            n = [linked @ mult[b], (linked.T @ mult[a])[inner_[b].astype(bool)]]
            ids = [rep[a], rep[b][inner_[b].astype(bool)]]
            label_a, label_b = rep[a].copy(), rep[b].copy()
            big = np.iinfo(np.int64).max
            while True:
                new_a = np.minimum(label_a, np.where(linked, label_b, big).min(axis=1))
                new_b = np.minimum(label_b, np.where(linked, new_a[:, None], big).min(axis=0))
                if (new_a == label_a).all() and (new_b == label_b).all():
                    break
                label_a, label_b = new_a, new_b
            node, label = np.concatenate([rep[a], rep[b]]), np.concatenate([label_a, label_b])
            node, at = np.unique(node[node != label], return_index=True)[0], np.unique(node[node != label], return_index=True)[1]
            label = label[np.concatenate([rep[a], rep[b]]) != label][at] if len(node) else label[:0]
            count, forest = np.concatenate(ids), len(node)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([count, node])),
                    pa.array(np.concatenate([np.concatenate(n), np.zeros(forest, dtype=np.int64)]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(count), dtype=np.int64), label]), mask=np.concatenate([np.ones(len(count), dtype=bool), np.zeros(forest, dtype=bool)])),
                ],
                names=["rep", "n", "to"],
            )

    made = parts[0].unionByName(parts[1]).repartition("part").sortWithinPartitions("part").mapInArrow(compare, "rep bigint, n bigint, to bigint")
    made = scratch.save(made, "counted")
    n = inner.unionByName(made.filter("to is null").select("rep", "n")).groupBy("rep").agg(F.sum("n").alias("n"))
    forest = stars.unionByName(made.filter("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    return n, forest


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    scratch = Scratch(spark, "vectors")
    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(vector).alias("x"))
    lengths = source.filter("x is not null").groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths[0] if lengths else 0
    rows = scratch.save(unit_vectors(source, vector, dim), "rows")
    classes = scratch.save(rows.filter("h is not null").groupBy("h").agg(F.min("row").alias("rep"), F.count("*").alias("mult")), "classes")
    reps = scratch.save(classes.select("rep", "mult").join(rows.select(F.col("row").alias("rep"), "v", "half"), "rep"), "reps")

    near = threshold - MARGIN
    graph = spark.createDataFrame([], "u bigint, v bigint, sim double")
    roots = spark.createDataFrame([], "id bigint, root bigint")
    seed = 0
    for attempt in range(ATTEMPTS):
        held = reps.select("rep", "half").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "half")
        held = scratch.save(held, f"held-{attempt}")
        graph = descended(scratch, held, outside(graph, held) if attempt else graph, seed, dim, near, f"graph-{attempt}")
        roots = scratch.save(joined(scratch, roots, links_of(graph, near), f"near-{attempt}"), f"roots-{attempt}")
        roots, seed = bridged(scratch, reps, roots, seed + 1, dim, near, f"bridge-{attempt}")
        recall = audited(spark, reps, roots, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"after {ATTEMPTS} attempts the audited recall is {recall:.3f}, under {RECALL}")

    members = reps.join(roots, F.col("rep") == F.col("id")).select("rep", "root", "mult", "v")
    n, forest = counted(scratch, members, threshold)
    root = components(scratch, forest, "linked")
    by_class = classes.select("h", "rep", "mult").join(n, "rep", "left").join(root, F.col("rep") == F.col("id"), "left")
    by_class = by_class.select("h", F.coalesce("root", "rep").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    whole = rows.select("row", F.col("id").alias("key"), "h").join(by_class, "h", "left")
    whole = scratch.save(whole.select("row", "key", F.coalesce("comp", "row").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "members")
    scratch.keep("members")
    least = whole.groupBy("comp").agg(F.min("key").alias("component_id"))
    return whole.join(least, "comp").select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
