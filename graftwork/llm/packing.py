"""Best-two-fit packing of token sequences.

A sequence is filled greedily, each time with the longest unpacked piece that
fits; then, as long as that leaves a smaller gap, its smallest piece is
exchanged for the two unpacked pieces that fit the expanded gap most tightly.

Which pieces share a length makes no difference to the packing, so it is
worked out once on the counts by length, at most `capacity` numbers however
large the corpus is: a filled sequence is a pattern of lengths, repeated as
often as the counts allow. Pieces then look up their places by length and
rank, without moving to a common task. A rank is the piece's place in its own
task, plus the number of pieces of that length in tasks before it.

Defined results: a null or empty text is the end token alone. Only documents
longer than the capacity are cut, into whole pieces and a rest. Repeated rows
are packed each on its own; an empty table gives no sequences; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch, released, values_of

CAPACITY = 2048
END_ID = 0
#: Distinct white-space-free chunks whose ids a worker remembers; beyond this it starts anew.
MAX_CHUNKS = 400_000
#: Characters of texts whose new chunks are encoded together.
BLOCK_CHARS = 1 << 20


#: How a vocabulary has to cut texts for its chunks and words to be encoded apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The printable character that stands for each byte in byte-level vocabularies.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


class ChunkTokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    Where a vocabulary drops white space, no token crosses a space: a text's
    ids are those of its chunks, one after another, and each chunk is encoded
    once and remembered. Chunks of plain Latin letters, digits and marks are
    cut into words here and go to the vocabulary's merges word by word; any
    other chunk, and any text of another kind of vocabulary, is encoded by the
    library as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task; threads would only contend
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        cuts = made["pre_tokenizer"] or {}
        first = (cuts.get("pretokenizers") or [{}])[0]
        self.in_chunks = made["normalizer"] == NORMALIZER and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        self.marks = [t["content"] for t in made["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; new chunks of a megabyte of texts are looked at together."""
        if not self.in_chunks:
            for text in texts:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(text.replace("\n", " ").split(" "))
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        known = self.known
        new = set().union(*block).difference(known)
        if new:
            if len(known) + len(new) > MAX_CHUNKS:
                known.clear()
                new = set().union(*block)
            if len(self.words) > MAX_CHUNKS:
                self.words.clear()
            other = []
            for c in new:
                if PLAIN.fullmatch(c) and not any(m in c for m in self.marks):
                    known[c] = b"".join([self.words.get(w) or self._word(w) for w in PLAIN_WORDS.findall(c.lower())])
                else:
                    other.append(c)
            for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
                known[c] = np.array(e.ids, dtype="<u4").tobytes()
        for chunks in block:
            yield b"".join([known[c] for c in chunks])

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([BYTE_CHARS[b] for b in word.encode()])
        ids = self.words[word] = struct.pack(f"<{len(t := self.model.tokenize(shown))}I", *[x.id for x in t])
        return ids


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Counter, int]], int]:
    """Patterns of lengths with how often each is used; and the number of sequences."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    patterns: list[tuple[Counter, int]] = []
    total = 0
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return patterns, total
        # below[g]: the longest length at most g that is left
        used: Counter = Counter()
        gap = capacity
        while gap:
            have = have[have <= gap]
            while len(have) and left[have[-1]] <= used[int(have[-1])]:
                have = have[:-1]
            if not len(have):
                break
            n = int(have[-1])
            k = int(min(gap // n, left[n] - used[n]))
            used[n] += k
            gap -= n * k
        while gap and (pair := best_two(left, used, gap)):
            small, a, b = pair
            used[small] -= 1
            if not used[small]:
                del used[small]
            used[a] += 1
            used[b] += 1
            gap -= a + b - small
        times = int(min(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= k * times
        patterns.append((used, times))
        total += times


def best_two(left: np.ndarray, used: Counter, gap: int) -> tuple[int, int, int] | None:
    """(smallest piece, a, b): two unpacked pieces that fill more of its place and the gap than it does."""
    small = min(used)
    room = gap + small
    free = left.copy()
    for n, k in used.items():
        free[n] -= k
    sizes = np.flatnonzero(free[: room + 1] > 0)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, room - sizes, "right") - 1
    ok = at >= 0
    # a length needs two pieces to go with itself; else take the next shorter one
    self_ = ok & (sizes[np.maximum(at, 0)] == sizes) & (free[sizes] < 2)
    at = np.where(self_, at - 1, at)
    ok = at >= 0
    if not ok.any():
        return None
    sums = np.where(ok, sizes + sizes[np.maximum(at, 0)], 0)
    i = int(np.argmax(sums))
    if sums[i] <= small:
        return None
    return small, int(sizes[i]), int(sizes[at[i]])


class Places:
    """For each (length, rank): the sequence and the offset in it."""

    def __init__(self, patterns: list[tuple[Counter, int]]):
        rows, first, taken = [], 0, Counter()
        for used, times in patterns:
            offset = 0
            for n, k in sorted(used.items(), reverse=True):
                rows.append((n, taken[n], first, k, offset))
                taken[n] += k * times
                offset += n * k
            first += times
        rows.sort()
        self.length, self.rank, self.first, self.each, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T.copy()
        self.keys = self.length * (1 << 48) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * (1 << 48) + rank, "right") - 1
        inside = rank - self.rank[at]
        return self.first[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, key: str, text: str) -> DataFrame:
    """One row per piece, with the task that made it and its place among that task's pieces of its length."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = ["piece", "start", "length", "ids_crc32", "task", "local"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = ChunkTokenizer(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            index, rows = [], []
            for i, ids in enumerate(tok.encode(values_of(batch.column("t")))):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    index.append(i)
                    rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(index, pa.int64())), pa.array(numbers[:, 0], pa.int32()), *(pa.array(numbers[:, c].copy()) for c in range(1, 6))], names=["key", *names])

    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(released(run), f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, local bigint")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, capacity, key, text), "pieces")
    by_task = scratch.save(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    patterns, _ = plan(counts, capacity)
    places = spark.sparkContext.broadcast(Places(patterns))  # at most a few patterns a length
    before = by_task.select("task", "length", (F.expr("sum(n) OVER (PARTITION BY length ORDER BY task)") - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["task", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    kind = dict(pieces.dtypes)["key"]
    return ranked.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("key", key)
