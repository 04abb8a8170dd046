"""WARC archives: written by tasks, read back by boundary-chain verification.

Writing: each task appends records to files of its own in the shared folder;
the files that count are those that the staged manifest names, so a lost or
repeated task leaves at most unused files. Of records with equal payloads of
at least `min_revisit` bytes, one is a response and the others revisit it.

Reading: files are cut into blocks. A task per block looks for every place
that reads like a record's head, a payload's copy of one included, and emits
where the record after it would start; chains inside the block are followed
there, which leaves each candidate's first place outside it. Pointer jumping
from each file's start over these links finds the blocks' true entries in
log2(blocks) rounds; reading then walks from each entry, so that magic inside
a payload is never taken for a record.

Defined results: a null html is an empty payload. Rows with equal payloads
and the same largest key are all responses; a null key revisits the largest
one if there is any, else it is a response. A record that runs past the end
of its file is not returned, nor is any after it; reading back what was
written raises unless each file has as many records as the manifest says. A
head may have any length. Keys are of any type that a text can be cast back to.
Other columns are ignored; an empty table writes no
file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes read for a record's head at first; as long as the head goes on, the window is doubled.
HEAD = 1 << 16
FILE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
#: A table of repeated payloads up to this many rows is broadcast, a larger one joined by shuffle.
MAX_BROADCAST = 100_000
#: Tasks that read blocks; beyond it each reads several.
MAX_TASKS = 20_000
URN = "urn:page:"


def name_of(key: str | None) -> str:
    """A key as the last part of a record's URN; a null one has none."""
    return "null" if key is None else "is-" + quote(str(key), safe="")


def record(kind: str, page_id: str | None, url: str | None, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    clean = re.sub(r"[\r\n]+", " ", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{name_of(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{name_of(refers_to)}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(data: bytes, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """(fields, where the body starts, its length) of a record's head at this place, which data holds whole."""
    if not MAGIC.match(data, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    n = fields.get(b"content-length", b"")
    if not n.isdigit() or b"warc-type" not in fields:
        return None
    return fields, end + 4, int(n)


def write_archives(spark: SparkSession, pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all rows; returns the manifest (file, size, records)."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= min_revisit
    many = rows.filter(large).groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("to")).filter((F.col("n") > 1) & F.col("to").isNotNull())
    many = scratch.save(many.select("digest", "to"), "repeated")
    if many.count() <= MAX_BROADCAST:
        many = F.broadcast(many)
    to = F.when(large & F.col("to").isNotNull() & ~F.col("key").eqNullSafe(F.col("to")), F.col("to"))
    rows = rows.join(many, "digest", "left").select(F.col("key").cast("string").alias("key"), "url", "payload", "digest", to.cast("string").alias("to"))
    folder = scratch.at("archives")
    kept = F.lit(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for key_, url_, data, digest, to_ in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc"
                    out, size, records = fs.open_output_stream(f"{root}/{name}"), 0, 0
                made = record("response" if to_ is None else "revisit", key_, url_, data, bytes.fromhex(digest), to_)
                out.write(made)
                size, records = size + len(made), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=["file", "size", "records"])

    made = rows.mapInArrow(run, "file string, size bigint, records bigint")
    return scratch.save(made.withColumn("folder", kept), "manifest")


def opened(folder: str, file: str):
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs.open_input_file(f"{root}/{file}")


def spread(rows: DataFrame, *keys) -> DataFrame:
    """A block a task, or some blocks where there are more than MAX_TASKS; a number that adaptive execution doesn't reduce."""
    return rows.repartition(max(1, min(rows.count(), MAX_TASKS)), *keys)


def head_at(f, at: int, size: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """parse_head of a file's record, however long its head is."""
    window = HEAD
    while True:
        f.seek(at)
        data = f.read(min(window, size - at))
        if b"\r\n\r\n" in data or len(data) < window or not MAGIC.match(data):
            return parse_head(data, 0)
        window *= 2


def candidates(f, block: int, stop: int, size: int) -> list[tuple[int, int]]:
    """(place, place of the successor) of every head that starts in [block, stop) of the file, from the last to the first."""
    window = HEAD
    while True:
        f.seek(block)
        data = f.read(min(stop + window, size) - block)
        if (found := heads_in(data, stop - block, stop + window >= size)) is not None:
            return [(block + at, after) for at, to in found if (after := block + to + 4) <= size]
        window *= 2


def heads_in(data: bytes, stop: int, ended: bool) -> list[tuple[int, int]] | None:
    """(place, where the body ends) of the heads that start before stop, from the last to the first; None if one goes on
    beyond data, which isn't at the file's end. Lines that a later head has too are read once."""
    known: dict[int, tuple[bytes | None, bool, int] | None] = {}
    out = []
    for m in reversed([m for m in MAGIC.finditer(data, 0, stop + 10) if m.start() < stop]):
        at, length, typed, told = m.end(), None, False, None
        while at not in known:
            end = data.find(b"\r\n", at)
            if end < 0:
                if not ended:
                    return None
                break
            if end == at:
                told = (length, typed, at + 2)
                break
            name, colon, value = data[at:end].partition(b":")
            if not colon:
                break
            name = name.strip().lower()
            if name == b"content-length":
                length = value.strip()
            typed, at = typed or name == b"warc-type", end + 2
        else:
            if (rest := known[at]) is not None:
                told = (length if rest[0] is None else rest[0], rest[1] or typed, rest[2])
        known[m.end()] = told
        if told is not None and told[1] and (told[0] or b"").isdigit():
            out.append((m.start(), told[2] + int(told[0])))
    return out


def link_blocks(manifest: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(folder, file, at, to, stop, n): each candidate, the first place outside its block that its chain reaches, and the chain's records in the block."""
    blocks = manifest.select("folder", "file", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block_bytes))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                stop = min(block + block_bytes, size)
                with opened(folder, file) as f:
                    found = candidates(f, block, stop, size)
                links: dict[int, int] = {}
                counts: dict[int, int] = {}
                for at, after in found:
                    # a successor in the block that is no candidate ends the chain there
                    links[at] = links.get(after, after) if after < stop else after
                    counts[at] = 1 + counts.get(after, 0)
                if links:
                    n = len(links)
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * n), pa.array([file] * n), pa.array(list(links)), pa.array(list(links.values())), pa.array([stop] * n), pa.array(list(counts.values()))], names=["folder", "file", "at", "to", "stop", "n"])

    return spread(blocks, F.col("file"), F.col("block")).mapInArrow(run, "folder string, file string, at bigint, to bigint, stop bigint, n bigint")


def reachable(scratch: Scratch, links: DataFrame) -> DataFrame:
    """The candidates that a file's start reaches, by pointer jumping: after k
    rounds all that are fewer than 2^k links away."""
    reach = scratch.save(links.filter("at = 0").select("folder", "file", "at", "stop"), "reach-0")
    stops = links.select("file", F.col("at").alias("to"), F.col("stop").alias("stop_"))
    jump, n, k = links.select("file", "at", "to"), reach.count(), 0
    while True:
        k += 1
        new = reach.join(jump, ["file", "at"]).join(stops, ["file", "to"]).select("folder", "file", F.col("to").alias("at"), F.col("stop_").alias("stop"))
        reach = scratch.save(reach.unionByName(new).distinct(), f"reach-{k}")
        now = reach.count()
        if now == n:
            return reach
        n = now
        nxt = jump.select("file", F.col("at").alias("to"), F.col("to").alias("to_"))
        jump = scratch.save(jump.join(nxt, ["file", "to"]).select("file", "at", F.col("to_").alias("to")), f"jump-{k}")


def verify_counts(manifest: DataFrame, links: DataFrame, reached: DataFrame) -> None:
    """Raise if the true entries' chains hold other numbers of records than were written."""
    told = reached.select("file", "at").join(links.select("file", "at", "n"), ["file", "at"]).groupBy("file").agg(F.sum("n").alias("found"))
    bad = manifest.join(told, "file", "left").filter(~F.col("records").eqNullSafe(F.col("found"))).select("file", "records", "found").first()
    if bad is not None:
        raise ValueError(f"archive {bad.file}: {bad.records} records were written, {bad.found} found")


def read_records(entries: DataFrame) -> DataFrame:
    """Walk the records from each entry to its block's end."""
    schema = "key string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file, at, stop in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with opened(folder, file) as f:
                    size = f.size()
                    while at < stop:
                        head = head_at(f, at, size)
                        if head is None or at + head[1] + head[2] + 4 > size:
                            break
                        fields, start, length = head
                        f.seek(at + start)
                        rows.append(parsed(fields, f.read(length)))
                        held, at = held + length, at + start + length + 4
                        if held > 4 << 20:
                            yield table_of(rows)
                            rows, held = [], 0
                if rows:
                    yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["key", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    return spread(entries.select("folder", "file", "at", "stop"), F.col("file"), F.col("at")).mapInArrow(run, schema)


def urn(value: bytes | None) -> str | None:
    found = re.fullmatch(rb"<" + URN.encode() + rb"is-([^>]*)>", value or b"")
    return unquote(found[1].decode()) if found else None


def parsed(fields: dict[bytes, bytes], body: bytes) -> tuple:
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode()
    said = base64.b32decode(fields[b"warc-payload-digest"].partition(b":")[2]).hex()
    if kind == "revisit":
        # the payload is with the record referred to; its length is in the kept HTTP head
        size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
        return urn(fields[b"warc-record-id"]), fields.get(b"warc-target-uri", b"").decode(), kind, None, size, said, urn(fields.get(b"warc-refers-to"))
    digest = hashlib.sha1(payload).hexdigest()
    if digest != said:
        raise ValueError(f"record {fields[b'warc-record-id']!r}: its payload's digest is {digest}, not {said}")
    return urn(fields[b"warc-record-id"]), fields.get(b"warc-target-uri", b"").decode(), kind, payload, len(payload), digest, None


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000, file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write all rows as archives and read these back: one row per record."""
    scratch = Scratch(spark, "warc")
    manifest = write_archives(spark, pages, scratch, key, url, html, min_revisit, file_bytes)
    links = scratch.save(link_blocks(manifest, block_bytes), "links")
    reached = reachable(scratch, links)
    verify_counts(manifest, links, reached)
    kind = pages.schema[key].dataType
    return read_records(reached).withColumns({"key": F.col("key").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("key", key)
