"""Secret scans by a recursive decoding worklist.

A text is scanned as it stands (the base spans), then unwrapped: percent
escapes, Unicode escapes, base64 runs and compressed bytes each give a further
layer, which is scanned and unwrapped in turn until no layer gives a new one.
Layers are known by their digest, so a text that decodes to itself, or two
that decode to each other, end. Every layer carries, for each of its
characters, the code points of the whole text that it came from, so a find in
a nested layer is reported as a span of the text.

A base64 run may be wrapped over lines, and is read in all four phases, as
what stands before it (`key-`, `dir/x/`) belongs to the same alphabet. Bytes
that are no UTF-8 are scanned as single characters, texts with NULs also
without these (which covers UTF-16 and UTF-32). Compressed streams (gzip of
any number of members, zlib, bzip2, xz, zstd) are looked for anywhere in the
bytes of base64 runs and escapes; what is in a stream has the whole run as its
span. A stream is unpacked in pieces of some 32 MB, cut between runs of the
decoders' alphabets, so nothing of it is dropped and memory stays bounded
however far it grows; pieces overlap by 64 KB, so that only a find with more
than that between its two ends could be missed.

Defined results: a null text is empty; an empty text has no spans. Repeated
rows are scanned each on its own; other columns are ignored. A text is
scanned whole, however long.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "api")
IS_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
ALPHABET = "[A-Za-z0-9+/_-]"
BASE64 = re.compile(rf"(?:{ALPHABET}{{16,}}(?:[ \t]*\r?\n[ \t]*{ALPHABET}{{4,}})*|{ALPHABET}{{8,}}(?:[ \t]*\r?\n[ \t]*{ALPHABET}{{8,}})+)(?:[ \t]*\r?\n[ \t]*{ALPHABET}{{1,7}}(?==))?={{0,2}}")
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
IN_ALPHABET = bytes(97 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-") else 110 if i in (9, 10, 13, 32) else 46 for i in range(256))


def may_hold_base64(text: str) -> bool:
    """A quick look for what BASE64 needs: 16 characters in a row, or 8 before a line's end."""
    flags = text.encode("utf-8", "surrogatepass").translate(IN_ALPHABET)
    return b"a" * 16 in flags or (b"a" * 8 + b"n" in flags and "\n" in text)


#: Bytes of a compressed stream that are held at once, and how far its pieces overlap.
PIECE = 32 << 20
OVERLAP = 64 << 10
#: Bytes that no encoded run holds: a stream is cut there.
APART = re.compile(rb"[^A-Za-z0-9+/_=%\\{}\s-]")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """The base spans of one layer, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.encode("utf-8", "surrogatepass").translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


class Layer:
    """Text, and for each character where in the whole text it starts and ends; `whole` if that is one span for all."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, made: np.ndarray | None = None, whole: tuple[int, int] | None = None):
        self.text, self.whole = text, whole
        n = 0 if whole else len(text)
        self.starts = np.arange(n) if starts is None else starts
        self.ends = np.arange(1, n + 1) if ends is None else ends
        self.made = np.zeros(n, dtype=bool) if made is None else made

    def at(self, start: int, end: int) -> tuple[int, int]:
        return self.whole or (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def is_made(self, start: int, end: int) -> bool:
        return self.whole is not None or bool(self.made[start:end].any())

    def mark(self) -> bytes:
        """The same words at another place are another layer."""
        where = repr(self.whole).encode() if self.whole else self.starts[:1].tobytes() + self.ends[-1:].tobytes()
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass") + where, digest_size=16).digest()


def spread(data: bytes, starts: list[int], ends: list[int]) -> tuple[str, list[int], list[int]]:
    """UTF-8 bytes, each with its place, as characters with theirs."""
    text = data.decode("utf-8", "replace")
    if len(text) == len(data):
        return text, starts, ends
    out_s, out_e, at = [], [], 0
    for c in text:
        # a replaced byte sequence has no certain width; one byte keeps the map monotone
        width = 1 if c == "�" and data[at : at + 3] != b"\xef\xbf\xbd" else len(c.encode("utf-8", "surrogatepass"))
        last = min(at + width, len(data)) - 1
        out_s.append(starts[min(at, last)])
        out_e.append(ends[last])
        at = min(at + width, len(data) - 1)
    return text, out_s, out_e


def replaced(layer: Layer, pattern: re.Pattern[str], decode) -> Layer | None:
    """The layer with every match of the pattern decoded in place."""
    text, s, e, made, at, any_ = [], [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        new, starts, ends = decode(layer, m)
        if new is None:
            continue
        any_ = True
        text += [layer.text[at : m.start()], new]
        if not layer.whole:
            s += [layer.starts[at : m.start()], np.array(starts, dtype=np.int64)]
            e += [layer.ends[at : m.start()], np.array(ends, dtype=np.int64)]
            made += [layer.made[at : m.start()], np.ones(len(new), dtype=bool)]
        at = m.end()
    if not any_:
        return None
    text.append(layer.text[at:])
    if layer.whole:
        return Layer("".join(text), whole=layer.whole)
    return Layer("".join(text), np.concatenate([*s, layer.starts[at:]]), np.concatenate([*e, layer.ends[at:]]), np.concatenate([*made, layer.made[at:]]))


def percent_bytes(m: re.Match[str]) -> bytes:
    return bytes.fromhex(m[0].replace("%", ""))


def percent(layer: Layer, m: re.Match[str]):
    data = percent_bytes(m)
    a = m.start()
    if layer.whole:
        return data.decode("utf-8", "replace"), (), ()
    return spread(data, [int(layer.starts[a + 3 * i : a + 3 * i + 3].min()) for i in range(len(data))], [int(layer.ends[a + 3 * i : a + 3 * i + 3].max()) for i in range(len(data))])


def escape(layer: Layer, m: re.Match[str]):
    units, starts, ends = [], [], []
    for x in ONE_ESCAPE.finditer(layer.text, m.start(), m.end()):
        code = int(x[1] or x[2] or x[3], 16)
        if code > 0x10FFFF:
            return None, None, None
        s, e = layer.at(x.start(), x.end())
        if units and 0xDC00 <= code < 0xE000 and 0xD800 <= units[-1] < 0xDC00:
            units[-1] = 0x10000 + ((units[-1] - 0xD800) << 10) + code - 0xDC00
            ends[-1] = e
        else:
            units.append(code)
            starts.append(s)
            ends.append(e)
    return "".join("�" if 0xD800 <= u < 0xE000 else chr(u) for u in units), starts, ends


def escape_bytes(m: re.Match[str]) -> bytes:
    """The escaped bytes, nothing if an escape is no byte."""
    codes = [int(x[1] or x[2] or x[3], 16) for x in ONE_ESCAPE.finditer(m[0])]
    return bytes(codes) if max(codes) < 256 else b""


def without_nuls(layer: Layer, m: re.Match[str]):
    return "", (), ()


NULS = re.compile("\0+")
ZLIB = type(zlib.decompressobj())


def opened(data: bytes):
    """(a decompressor, its block size) for the stream at the start of data, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of the stream at the start of data, some of it at a time; what a broken stream gave before it broke counts."""
    import zstandard

    while (d := opened(data)) is not None:
        try:
            if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                part = d.decompress(data, PIECE // 4)
                while part or not (d.eof or d.needs_input):
                    yield part
                    part = b"" if d.eof or d.needs_input else d.decompress(b"", PIECE // 4)
            elif isinstance(d, ZLIB):
                part = d.decompress(data, PIECE // 4)
                while part or d.unconsumed_tail:
                    yield part
                    part = b"" if d.eof else d.decompress(d.unconsumed_tail, PIECE // 4)
            else:
                rest = data
                for at in range(0, len(data), 1 << 12):  # a block of input at a time, as there is no limit on the output
                    yield d.decompress(data[at : at + (1 << 12)])
                    if d.eof:
                        rest = data[: at + (1 << 12)]
                        break
                if not d.eof:
                    return
                data = d.unused_data + data[len(rest) :]
                continue
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            return
        if not d.eof:
            return
        data = d.unused_data


def pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """A stream's content in pieces that no encoded run crosses, each with the end of the one before it."""
    held = b""
    for part in parts:
        held += part
        if len(held) >= PIECE:
            cut = None
            for m in APART.finditer(held, len(held) // 2):
                cut = m.end()
            if cut is not None:
                yield held[:cut]
                held = held[max(cut - OVERLAP, 0) :]
    if held:
        yield held


def packed_layers(data: bytes, span: tuple[int, int]) -> Iterator[Layer]:
    """What compressed streams anywhere in the bytes hold, streams within streams too."""
    for m in STREAM.finditer(data):
        for piece in pieces(inflated(data[m.start() :])):
            try:
                text = piece.decode("utf-8")
            except UnicodeDecodeError:
                text = piece.decode("latin-1")
            yield Layer(text, whole=span)
            yield from packed_layers(piece, span)


def base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        place = np.arange(m.start(), m.start() + len(run))
        if "\n" in run:
            place = place[[not c.isspace() for c in run]]
            run = "".join(run.split())
        run = run.replace("-", "+").replace("_", "/")
        a, b = m.span()
        for phase in range(4):
            part = run[phase:]
            part = part[: -1 if len(part) % 4 == 1 else None]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            if not data:
                continue
            yield from packed_layers(data, layer.at(a, b))
            if layer.whole:
                try:
                    yield Layer(data.decode("utf-8"), whole=layer.whole)
                except UnicodeDecodeError:
                    yield Layer(data.decode("latin-1"), whole=layer.whole)
                continue
            i = np.arange(len(data))
            first, last = place[phase + i * 4 // 3], place[np.minimum(phase + (i * 8 + 7) // 6, len(place) - 1)]
            starts, ends = layer.starts[first], layer.ends[last]
            try:
                data.decode("utf-8")
            except UnicodeDecodeError:
                text = data.decode("latin-1")
            else:
                text, starts, ends = spread(data, starts, ends)
            yield Layer(text, np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64), np.ones(len(text), dtype=bool))


def children(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text and (x := replaced(layer, PERCENT, percent)):
        yield x
        for m in PERCENT.finditer(layer.text):
            yield from packed_layers(percent_bytes(m), layer.at(*m.span()))
    if "\\" in layer.text and (x := replaced(layer, ESCAPE, escape)):
        yield x
        for m in ESCAPE.finditer(layer.text):
            yield from packed_layers(escape_bytes(m), layer.at(*m.span()))
    if "\0" in layer.text and (x := replaced(layer, NULS, without_nuls)):
        x.made[:] = True
        yield x
    if may_hold_base64(layer.text):
        yield from base64_layers(layer)


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text."""
    base = scan(text)
    spans = set(base)
    if not ("%" in text or "\\" in text or "\0" in text or may_hold_base64(text)):
        return base, base
    top = Layer(text)
    seen, work = {top.mark()}, [top]
    while work:
        for child in children(work.pop()):
            if not child.text or (mark := child.mark()) in seen:
                continue
            seen.add(mark)
            for kind, s, e in scan(child.text):
                if child.is_made(s, e):
                    spans.add((kind, *child.at(s, e)))
            work.append(child)
    return base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base and spans, each an array of (kind, start, stop).

    Code points, end exclusive; by start, then kind. Every base span is also a span.
    """
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find_spans(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[{"kind": k, "start": s, "stop": e} for k, s, e in x[i]] for x in both], item) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return source.mapInArrow(run, f"key {dict(source.dtypes)['key']}, base {spans}, spans {spans}").withColumnRenamed("key", key)
