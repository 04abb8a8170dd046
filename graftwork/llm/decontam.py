"""Benchmark decontamination by greedy string tiling.

Texts are words of letters and digits, lower-cased, so punctuation and spacing
don't hide a leak. A document and a test item that share a seed, a run of
`seed` words, are tiled: the longest match of unmarked words is marked in
both, again and again, down to `tile` words, which running Karp-Rabin hashes of
that length find, comparing words confirms and neighbours on a diagonal extend;
places go in stretches, so texts that repeat themselves cost time and not
memory. The share of the item's words
under tiles is its coverage; as tiles may come in any order, reordered
passages count in full.

Items with fewer words than a seed are seeds themselves; items without words
match nothing. While the items have at most `max_words` words they are
broadcast as arrays; beyond that the seeds are joined by shuffle, and each
candidate pair meets its two texts. Both ways give the same pairs.

Defined results: a null or empty text matches nothing. Repeated rows are
judged each on its own. Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.llm.common import Scratch, released, values_of
from graftwork.llm.shingles import WordHasher, grams

WORD = re.compile(r"\w+")
SEED = 5
TILE = 3
COVERAGE = 0.5
MAX_WORDS = 20_000_000
Tile = tuple[int, int, int]


def tokens(hasher: WordHasher, text: str | None) -> np.ndarray:
    return hasher([w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").lower())])


#: Pairs of equal places that are held at once.
MAX_PAIRS = 1 << 20
BASE = 0x5851F42D4C957F2D


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of `size` words: sums over prefixes, modulo 2^64, brought to one power of the odd base."""
    n = len(words) - size + 1
    back, power = np.full(len(words), pow(BASE, -1, 1 << 64), dtype=np.uint64), np.full(max(n, 0), BASE, dtype=np.uint64)
    back[:1] = power[:1] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * np.cumprod(back, dtype=np.uint64), dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * np.cumprod(power, dtype=np.uint64)


def segments(doc: np.ndarray, item: np.ndarray, tile: int) -> np.ndarray:
    """Maximal matches of at least `tile` words: rows (length, start in item, start in doc).

    Places of the document go in stretches with at most MAX_PAIRS places of the
    item that have their hash; equal hashes are confirmed word by word, and
    runs along a diagonal go on over a stretch's end.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    if len(doc) < tile or len(item) < tile:
        return none
    dh, ih = rolling(doc, tile), rolling(item, tile)
    order = np.argsort(ih, kind="stable")
    lo, hi = np.searchsorted(ih[order], dh, "left"), np.searchsorted(ih[order], dh, "right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return none
    upto = np.cumsum(hi[at] - lo[at])
    done: list[np.ndarray] = []
    open_ = none  # runs that reach the last place of the stretch before
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MAX_PAIRS, "right")))
        here = at[a:b]
        many = hi[here] - lo[here]
        d = np.repeat(here, many)
        i = order[np.repeat(lo[here], many) + np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)]
        same = np.ones(len(d), dtype=bool)
        for k in range(tile):
            same &= doc[d + k] == item[i + k]
        d, i = d[same], i[same]
        by = np.lexsort((i, d - i))
        d, i = d[by], i[by]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(i) != 1)])) if len(d) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.concatenate([first, [len(d)]]))
        new = np.stack([size + tile - 1, i[first], d[first]], axis=1) if len(d) else none
        if len(open_) and len(new):
            was = {(int(r[2] - r[1]), int(r[2] + r[0] - tile + 1)): k for k, r in enumerate(open_)}
            ended = np.ones(len(open_), dtype=bool)
            for r in np.flatnonzero(new[:, 2] == here[0]):
                k = was.get((int(new[r, 2] - new[r, 1]), int(new[r, 2])))
                if k is not None:  # the same diagonal, and the next place
                    ended[k] = False
                    new[r] = (new[r, 0] + new[r, 2] - open_[k, 2], open_[k, 1], open_[k, 2])
            open_ = open_[ended]
        done.append(open_)
        goes_on = new[:, 2] + new[:, 0] - tile == here[-1]
        open_ = new[goes_on]
        done.append(new[~goes_on])
        a = b
    return np.concatenate([*done, open_])


def tiled(doc: np.ndarray, item: np.ndarray, tile: int) -> list[Tile]:
    """Greedy tiles, the longest first, then the earliest in the item, then in the document; ends when no tile fits the item any more."""
    found = segments(doc, item, tile)
    found = found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))]
    heap: list[Tile] = []  # what is left of matches that others cut
    in_item, in_doc = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    out, free, at = [], len(item), 0
    while free >= tile and (heap or at < len(found)):
        if at < len(found) and (not heap or (-found[at, 0], found[at, 1], found[at, 2]) <= heap[0]):
            n, i, d = found[at].tolist()
            at += 1
        else:
            n, i, d = heapq.heappop(heap)
            n = -n
        taken = in_item[i : i + n] | in_doc[d : d + n]
        if not taken.any():
            in_item[i : i + n] = in_doc[d : d + n] = True
            out.append((n, i, d))
            free -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= tile:
                heapq.heappush(heap, (a - b, i + a, d + a))
    return out


def seeds_of(words: np.ndarray, seed: int) -> np.ndarray:
    return np.unique(grams(words, seed))


class Items:
    """All test items as arrays, with a sorted array of their seeds."""

    def __init__(self, rows: list[tuple], seed: int):
        hasher = WordHasher()
        self.ids = [r[0] for r in rows]
        self.words = [tokens(hasher, r[1]) for r in rows]
        pairs: dict[int, tuple[list, list]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                size = min(seed, len(w))
                own = seeds_of(w, size)
                pairs.setdefault(size, ([], []))
                pairs[size][0].append(own)
                pairs[size][1].append(np.full(len(own), k))
        self.seeds = {}
        for size, (a, b) in pairs.items():
            hashes, owner = np.concatenate(a), np.concatenate(b)
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = (hashes[order], owner[order])

    def candidates(self, doc: np.ndarray) -> list[int]:
        found = set()
        for size, (hashes, owner) in self.seeds.items():
            own = grams(doc, size)
            lo = np.searchsorted(hashes, own, "left")
            hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == own)
            for h in np.unique(own[hit]):
                a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                found.update(owner[a:b].tolist())
        return sorted(found)


def judged(doc: np.ndarray, item: np.ndarray, tile: int) -> tuple[int, int, int]:
    """(tiles, words under them, words of the item)."""
    tiles = tiled(doc, item, min(tile, len(item)))
    return len(tiles), sum(n for n, _, _ in tiles), len(item)


NAMES = ["row", "id", "item_id", "n_tiles", "covered", "item_words"]


def pairs_schema(docs: DataFrame, items: DataFrame) -> T.StructType:
    numbers = [T.StructField(n, T.LongType()) for n in NAMES[3:]]
    return T.StructType([T.StructField("row", docs.schema["row"].dataType), T.StructField("id", docs.schema["id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), *numbers])


def by_broadcast(spark: SparkSession, docs: DataFrame, tests: DataFrame, seed: int, tile: int) -> DataFrame:
    table = tests.toArrow()
    ids = table.column("item_id").combine_chunks()
    items = spark.sparkContext.broadcast((ids, Items(list(enumerate(table.column("text").to_pylist())), seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        ids, known = items.value
        for batch in batches:
            index, which, found = [], [], []
            for i, t in enumerate(values_of(batch.column("t"))):
                words = tokens(hasher, t)
                for k in known.candidates(words) if len(words) else ():
                    index.append(i)
                    which.append(k)
                    found.append(judged(words, known.words[k], tile))
            own = batch.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("row"), own.column("id"), ids.take(pa.array(which, pa.int64())), *(pa.array([f[c] for f in found], pa.int64()) for c in range(3))], names=NAMES)

    return docs.mapInArrow(released(run), pairs_schema(docs, tests))


def by_shuffle(scratch: Scratch, docs: DataFrame, items: DataFrame, seed: int, tile: int) -> DataFrame:
    """The way for test sets without a bound: seeds are joined, then texts."""
    items = scratch.save(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def seeded(rows: DataFrame, name: str, sizes: tuple[int, ...], whole: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher()
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = tokens(hasher, t)
                    for size in {min(seed, len(words))} - {0} if whole else sizes:
                        own = seeds_of(words, size)
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), batch.column(0).type), pa.array(np.full(len(own), size)), pa.array(own.view(np.int64))], names=[name, "size", "seed"])

        return rows.mapInArrow(run, T.StructType([T.StructField(name, rows.schema[name].dataType), T.StructField("size", T.LongType()), T.StructField("seed", T.LongType())]))

    of_items = scratch.save(seeded(items.select("item", "text"), "item", (), True), "item-seeds")
    sizes = tuple(r[0] for r in of_items.select("size").distinct().collect())  # at most `seed` of them
    pairs = seeded(docs.select("row", "t"), "row", sizes, False).join(of_items, ["size", "seed"]).select("row", "item").distinct()
    both = scratch.save(pairs, "pairs").join(docs, "row").join(items.select("item", "item_id", "text"), "item").select("row", "id", "item_id", "t", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [judged(tokens(hasher, t), tokens(hasher, i), tile) for t, i in zip(batch.column("t").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "item_id")), *(pa.array([f[c] for f in found], pa.int64()) for c in range(3))], names=NAMES)

    return both.mapInArrow(released(run), pairs_schema(docs, items))


def tile_pairs(spark: SparkSession, docs: DataFrame, items: DataFrame, seed: int = SEED, tile: int = TILE, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", row: str | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """(row, id, item_id, n_tiles, covered, item_words, coverage) of each document and item whose coverage is reached.

    `row` may name a column of any type that can be joined on, which tells rows of equal keys apart.
    """
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    tests = items.select(F.col(item).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    # half the characters bound the words, as words are at least a character apart
    size = tests.agg(F.sum(F.ceil((F.length("text") + 1) / 2))).first()[0] or 0
    if size <= max_words:
        found = by_broadcast(spark, rows, tests, seed, tile)
    else:
        scratch = Scratch(spark, "tiling")
        found = by_shuffle(scratch, scratch.save(rows, "docs"), tests, seed, tile)
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= coverage)
