"""URL filters over sorted digest arrays.

Every rule and every listed host is one string in a `DigestArray`: its 64-bit
xxHash goes to a sorted array that each Python worker maps into memory, and
the string itself to a blob beside it. A batch of URLs turns into candidate
strings (each parent domain of the host, joined with each rule-path length's
prefix of the path), which are hashed, looked up by one vectorised binary
search, and confirmed against the stored strings, so a hash collision can
neither add nor hide a match.

Defined results: a null URL, or one without `://`, has an empty host and path,
fits no rule and gets the default verdict. Repeated rows are judged each on
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch, ascii_lower

Digest = Callable[[bytes], int]
#: Rules are configuration, read by the driver; a list beyond this is refused.
MAX_ENTRIES = 5_000_000


class DigestArray:
    """Sorted 64-bit keys with the strings they stand for, all memory-mapped."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, values: np.ndarray, blob: np.ndarray, digest: Digest = xxhash.xxh64_intdigest):
        self.keys, self.ends, self.values, self.blob, self.digest = keys, ends, values, blob, digest

    @staticmethod
    def build(entries: Iterable[tuple[str, int]], digest: Digest = xxhash.xxh64_intdigest) -> dict[str, bytes]:
        """The four .npy files of an array, by name."""
        rows = sorted((digest(s.encode()), s.encode(), v) for s, v in entries)
        if len(rows) > MAX_ENTRIES:
            raise ValueError(f"{len(rows)} entries; at most {MAX_ENTRIES} go into one array")
        parts = {
            "keys": np.array([k for k, _, _ in rows], dtype=np.uint64),
            "ends": np.cumsum([0, *(len(s) for _, s, _ in rows)], dtype=np.int64),
            "values": np.array([v for _, _, v in rows], dtype=np.int64),
            "blob": np.frombuffer(b"".join(s for _, s, _ in rows) or b"\0", dtype=np.uint8),
        }
        mark = hashlib.sha1(b"\0".join(x.tobytes() for x in parts.values())).hexdigest()[:16]
        out = {}
        for name, array in parts.items():
            np.save(to := io.BytesIO(), array)
            out[f"digests-{mark}-{name}.npy"] = to.getvalue()
        return out

    @classmethod
    def load(cls, paths: list[str], digest: Digest = xxhash.xxh64_intdigest) -> DigestArray:
        return cls(*(np.load(p, mmap_mode="r") for p in paths), digest=digest)

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The value of each string, or -1."""
        out = np.full(len(strings), -1, dtype=np.int64)
        if not len(self.keys) or not strings:
            return out
        probes = np.fromiter(map(self.digest, strings), dtype=np.uint64, count=len(strings))
        lo = np.searchsorted(self.keys, probes, "left")
        hi = np.searchsorted(self.keys, probes, "right")
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):
                if self.blob[self.ends[k] : self.ends[k + 1]].tobytes() == strings[i]:
                    out[i] = self.values[k]
                    break
        return out


def parents(host: str) -> list[str]:
    """The host and each domain above it."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def judge(hosts: list[str], paths: list[str], rules: DigestArray, lengths: list[int], listed: DigestArray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per URL: the number of the longest rule that fits (or -1), and whether its host is listed."""
    up = {h: parents(h) for h in set(hosts)}
    owner, strings = [], []
    for i, (h, p) in enumerate(zip(hosts, paths)):
        if not h:
            continue
        for n in lengths:
            if n <= len(p):
                head = p[:n]
                for d in up[h]:
                    owner.append(i)
                    strings.append((d + head).encode())
    best = np.full(len(hosts), -1, dtype=np.int64)
    found = rules.find(strings)
    for k in np.flatnonzero(found >= 0):
        i, r = owner[k], found[k]
        if best[i] < 0 or rank[r] > rank[best[i]]:
            best[i] = r
    flat = [(h, d) for h, ds in up.items() if h for d in ds]
    hit = listed.find([d.encode() for _, d in flat])
    bad = {h for (h, _), v in zip(flat, hit) if v >= 0}
    return best, np.array([h in bad for h in hosts], dtype=bool)


def filter_urls(
    spark: SparkSession,
    urls: DataFrame,
    rules: list[tuple[str, str, str]],
    blocked_hosts: Iterable[str] = (),
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Judge each row's URL: key, host, path, rule, verdict.

    `rules` holds (verdict, host, path); a rule fits its host and all
    subdomains when the URL's path starts with the rule's path, and the
    longest fitting rule decides (by its host and path together, then by its
    place in the list). Without one, a URL whose host or parent domain is in
    `blocked_hosts` is blocked and any other allowed.
    """
    names = [host + path for _, host, path in rules]
    verdicts = [v for v, _, _ in rules]
    lengths = sorted({len(path) for _, _, path in rules})
    rank = np.array([len(n) * (len(rules) + 1) - i for i, n in enumerate(names)], dtype=np.int64)
    first: dict[str, int] = {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
    scratch, files = Scratch(spark, "digests"), []
    for entries in (list(first.items()), [(h, 1) for h in sorted(set(blocked_hosts))]):
        # a name of its own, as Spark won't add two files of one name
        own = {f"{os.path.basename(scratch.path)}-{n}": data for n, data in DigestArray.build(entries).items()}
        for n, data in own.items():
            spark.sparkContext.addFile(scratch.put(n, data))
        files.append(list(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [DigestArray.load([SparkFiles.get(n) for n in fs]) for fs in files]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best, bad = judge(hosts, paths, arrays[0], lengths, arrays[1], rank)
            rule = [names[b] if b >= 0 else None for b in best]
            verdict = [verdicts[b] if b >= 0 else "block" if x else "allow" for b, x in zip(best, bad)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["key", "host", "path", "rule", "verdict"])

    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    parsed = urls.select(
        F.col(key).alias("key"),
        ascii_lower(F.regexp_extract(text, split, 1)).alias("host"),
        F.regexp_extract(text, split, 2).alias("path"),
    )
    kind = dict(parsed.dtypes)["key"]
    return parsed.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
