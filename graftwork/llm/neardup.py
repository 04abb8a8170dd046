"""MinHash near-dedup by a chosen-path set similarity join.

Every distinct shingle set has a signature of minima. A tree's node picks some
places of the signature by a hash of its path; documents with the same value
there share a child. Nodes of up to `SMALL` documents are compared
exhaustively, larger ones branch again; independent trees are repeated until
the target recall is met at the threshold. Candidates pass a signature
estimate (4.75 standard deviations below the threshold) and a size bound, and
are confirmed on full sets; links make components.

Work that can't change a component is left out: documents with equal sets are
one class from the start; each node of the first level links to leaders, and
only nodes that then hold more than one component are branched or compared. So a
group of thousands of copies costs a star, not its pairs. Nodes that are
still large at the last level are compared in blocks.

Defined results: a text without words (null and empty ones too) has an empty
set and is linked with nothing; one with fewer words than a shingle is a
single shingle. A component's id is its smallest key (nulls last); rows with
equal keys and texts share a class, and `first` is true for one row of each
component alone. Texts are read whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch, released, values_of
from graftwork.llm.components import components, joined
from graftwork.llm.shingles import MinHash, WordHasher, common, mix, shingle_set

PLACES = 128
#: Places that a root branches by at once; with one, texts of common words meet by chance ever more as a corpus grows.
AT_ROOT = 3
SMALL = 64
CHUNK = 1024
#: The names of up to this many candidates are broadcast to fetch their texts, more are joined by shuffle.
MAX_BROADCAST = 500_000
BRANCH = 2
DEPTH = 6
MISS = 1e-6
SIGMAS = 4.75


def trees_for(threshold: float, miss: float = MISS) -> int:
    """Trees that leave a pair at the threshold unfound with at most this chance: it has to share the root's places, then live on."""
    alive = 1.0
    for _ in range(200):
        alive = 1 - (1 - threshold * alive) ** BRANCH
    return math.ceil(math.log(miss) / math.log(1 - threshold**AT_ROOT * alive))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def signatures(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, PLACES)


def signed(docs: DataFrame, key: str, text: str, shingle: int, trees: int) -> DataFrame:
    """(id, a, b, n, h, first, sig) of each row: a and b name its key and text, h its set.

    `first` has the whole minima that the trees' roots branch by, `sig` the low
    byte of every minimum, enough to branch further and to estimate.
    """
    source = docs.select(F.col(key).alias("id"), *(F.xxhash64(F.lit(s), F.col(key), F.col(text)).alias(x) for s, x in enumerate("ab")), F.coalesce(text, F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minhash = WordHasher(), MinHash(PLACES)
        for batch in batches:
            n, h, first, sig = [], [], [], []
            for t in values_of(batch.column("t").cast(pa.binary())):
                s = shingle_set(hasher, t, shingle)
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = minhash(s)
                first.append(low[roots].tobytes())
                sig.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (h, first, sig))], names=["id", "a", "b", "n", "h", "first", "sig"])

    roots = np.arange(trees * AT_ROOT) * PLACES // (trees * AT_ROOT)
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(released(run), f"id {kind}, a bigint, b bigint, n bigint, h binary, first binary, sig binary")


def roots_of(reps: DataFrame, trees: int) -> DataFrame:
    """(node, rep): the first level's node of each class in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.frombuffer(b"".join(batch.column("first").to_pylist()), dtype="<u4").reshape(-1, trees, AT_ROOT).astype(np.uint64)
            for t in range(trees):
                node = np.full(len(first), t + 1, dtype=np.uint64)
                for j in range(AT_ROOT):
                    node = mix(node * np.uint64(0x9E3779B97F4A7C15) + first[:, t, j])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("rep")], names=["node", "rep"])

    return reps.select("rep", "first").mapInArrow(run, "node bigint, rep bigint")


def children_of(nodes: DataFrame) -> DataFrame:
    """(node, rep) one level down: each row of (node, rep, sig) in BRANCH children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(batch).astype(np.uint64)
            node = batch.column("node").to_numpy().view(np.uint64)
            for j in range(BRANCH):
                place = mix(node + np.uint64(j + 1)) % np.uint64(PLACES)
                child = mix(node * np.uint64(0x9E3779B97F4A7C15) + (place << np.uint64(32)) + sig[np.arange(len(node)), place.astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("rep")], names=["node", "rep"])

    return nodes.select("node", "rep", "sig").mapInArrow(run, "node bigint, rep bigint")


def candidates(rows: DataFrame, need: int, num: int, den: int, stars: bool) -> DataFrame:
    """Pairs (x, y), x < y, from rows (part, side, rep, n, comp, sig): leaders' stars, or all between components.

    A part is a node, or a chunk of one, or two chunks (side 0 and 1), of which only pairs across count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []
        held = 0
        for g in groups(batches, "part"):
            rep, n, comp, side = (g.column(c).to_numpy() for c in ("rep", "n", "comp", "side"))
            if len(rep) < 2:
                continue
            sig = signatures(g)
            order = np.argsort(rep, kind="stable")
            rep, n, comp, side, sig = rep[order], n[order], comp[order], side[order], sig[order]
            two = side.any() and not side.all()
            left = np.arange(len(rep))
            while len(left) > 1:
                lead, left = left[0], left[1:]
                ok = np.minimum(n[left], n[lead]) * den >= np.maximum(n[left], n[lead]) * num
                ok &= comp[left] != comp[lead]
                if two:
                    ok &= side[left] != side[lead]
                hit = left[ok]
                hit = hit[(sig[hit] == sig[lead]).sum(axis=1) >= need]
                if len(hit):
                    xs.append(np.full(len(hit), rep[lead]))
                    ys.append(rep[hit])
                    held += len(hit)
                    if stars:
                        left = left[~np.isin(left, hit)]
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])
                xs, ys, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])

    sent = rows.select("part", "side", "rep", "n", "comp", "sig")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(released(run), "x bigint, y bigint")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) with den * |intersection| >= num * |union| of full sets.

    x's text goes once to each of its groups of some 256 partners, however many it has.
    """
    many = pairs.groupBy("x").agg(F.ceil(F.count("*") / 256).alias("salts"))
    salted = pairs.join(many, "x").withColumn("part", F.xxhash64("x", F.pmod(F.xxhash64("y"), F.col("salts"))))
    text = texts.select("rep", "text")
    heads = salted.select("part", "x").distinct().join(text, F.col("x") == F.col("rep")).select("part", F.lit(0).alias("role"), "x", F.col("x").alias("y"), "text")
    others = salted.join(text, F.col("y") == F.col("rep")).select("part", F.lit(1).alias("role"), "x", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, heads_ = WordHasher(), {}
        part = None
        for batch in batches:
            xs, ys = [], []
            for p, role, x, y, t in zip(*(batch.column(c).to_pylist() for c in ("part", "role", "x", "y")), values_of(batch.column("text").cast(pa.binary()))):
                s = shingle_set(hasher, t or b"", shingle)
                if p != part:
                    part, heads_ = p, {}
                if role == 0:
                    heads_[x] = s
                    continue
                both = common(heads_[x], s)
                if den * both >= num * (len(s) + len(heads_[x]) - both):
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["a", "b"])

    return heads.unionByName(others).repartition("part").sortWithinPartitions("part", "role").mapInArrow(released(run), "a bigint, b bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept, first, and a, b (hashes of the row's key and text)."""
    scratch = Scratch(spark, "neardup")
    threshold = num / den
    trees = trees_for(threshold)
    need = math.ceil(PLACES * (threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / PLACES)))
    rows = scratch.save(signed(docs, key, text, shingle, trees).withColumn("row", F.monotonically_increasing_id()), "rows")
    full = rows.filter("n > 0")
    classes = scratch.save(full.groupBy("h").agg(F.min("row").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n", "first", "sig", "a", "b")

    first = roots_of(reps, trees)
    sizes = first.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    nodes = scratch.save(first.join(sizes, "node"), "nodes-1")
    known = scratch.save(reps.drop("first").join(nodes.select("rep").distinct(), "rep"), "known")
    named = docs.select(*(F.xxhash64(F.lit(s), F.col(key), F.col(text)).alias(x) for s, x in enumerate("ab")), F.col(text).alias("text"))

    def texts_of(pairs: DataFrame, name: str) -> DataFrame:
        """(rep, text) of the classes in the pairs, and of no others."""
        wanted = pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct()
        wanted = scratch.save(known.select("rep", "a", "b").join(wanted, "rep", "left_semi"), f"{name}-wanted")
        small = wanted.count() <= MAX_BROADCAST
        texts = named.join(F.broadcast(wanted) if small else wanted, ["a", "b"])
        return scratch.save(texts.dropDuplicates(["a", "b"]).select("rep", "text"), name)

    sketches = known.select("rep", "n", "sig")

    def held(nodes: DataFrame) -> DataFrame:
        """Nodes' rows with their component, without nodes of one component; signatures join only what is left."""
        rows_ = nodes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", "size", F.coalesce("root", "rep").alias("comp"))
        mixed = rows_.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("node")
        return rows_.join(mixed, "node", "left_semi")

    chunks = F.ceil(F.col("size") / CHUNK)
    chunk = F.pmod(F.xxhash64("rep", "node"), chunks)
    side = F.lit(0).alias("side")
    stars = nodes.select(F.xxhash64("node", chunk).alias("part"), side, "rep", F.col("rep").alias("comp"))
    pairs = scratch.save(candidates(stars.join(sketches, "rep"), need, num, den, stars=True).distinct(), "star-pairs")
    roots = components(scratch, scratch.save(confirm(pairs, texts_of(pairs, "star-texts"), shingle, num, den), "star-links"), "star-roots")

    small: DataFrame | None = None
    for level in range(1, DEPTH + 1):
        rows_ = scratch.save(held(nodes), f"held-{level}")
        own = rows_.filter(F.col("size") <= SMALL).select(F.col("node").alias("part"), side, "rep", "comp")
        small = own if small is None else small.unionByName(own)
        large = rows_.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if level == DEPTH:
            # the exact way for what is left: every chunk of a node meets every other
            mine = large.withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
            blocks = mine.select(
                F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("part"),
                F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
                "rep", "comp",
            )
            small = small.unionByName(blocks)
            break
        down = children_of(large.select("node", "rep").join(sketches.select("rep", "sig"), "rep"))
        sizes = down.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        nodes = scratch.save(down.join(sizes, "node"), f"nodes-{level + 1}")
    rest = scratch.save(candidates(small.join(sketches, "rep"), need, num, den, stars=False).distinct().join(pairs, ["x", "y"], "left_anti"), "rest-pairs")
    roots = joined(scratch, roots, scratch.save(confirm(rest, texts_of(rest, "rest-texts"), shingle, num, den), "rest-links"), "rest-roots")

    root = roots.withColumnRenamed("id", "rep")
    member = rows.filter("n > 0").select("row", "h").join(classes, "h").join(root, "rep", "left").select("row", F.coalesce("root", "rep").alias("comp"))
    whole = rows.select("row", F.col("id").alias("key"), "n", "a", "b").join(member, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    whole = scratch.save(whole, "members")
    scratch.keep("members")
    least = whole.groupBy("comp").agg(F.min("key").alias("component_id"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("lead"))
    return whole.join(least, "comp").select(
        F.col("key").alias("id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("row") == F.col("lead.row")).alias("first"),
        "a",
        "b",
    )
