import base64
import bz2
import gzip
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from graftwork.llm import secrets
from tests.llm import data


def brute(text):
    out = []
    for kind, pattern, flags, ok in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_base_spans_on_random_texts():
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "tokEn", "api_key", "apikey", "AKIA", "akia", "0123456789abcdef", "deadbeef", "=", " : ", "'", '"', " ", "\n", "é", "ABCDEFGHIJKLMN0", "xyz", "ſecret", "to\u212aen", "😀", "%41", "\\u0041"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        base, spans = secrets.find_spans(text)
        assert base == brute(text), text
        assert set(base) <= set(spans)


SECRET = 'password="hunter2hunter2"'


@pytest.mark.parametrize(
    "wrapped",
    [
        urllib.parse.quote(SECRET),
        urllib.parse.quote(urllib.parse.quote(SECRET)),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        base64.b64encode(SECRET.encode()).decode(),
        base64.urlsafe_b64encode(base64.b64encode(("ü " + SECRET).encode())).decode(),
        base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(zlib.compress(gzip.compress(SECRET.encode()))).decode(),
        urllib.parse.quote(base64.b64encode(zlib.compress(urllib.parse.quote(SECRET).encode())).decode()),
    ],
)
def test_nested_layers_are_found_inside_their_place(wrapped):
    text = f"é😀 before {wrapped} after"
    base, spans = secrets.find_spans(text)
    found = [s for s in spans if s not in base and s[0] == "assign"]
    assert found
    at = text.index(wrapped)
    assert all(at <= s and e <= at + len(wrapped) for _, s, e in found)


def test_cycles_end_and_plain_texts_gain_nothing():
    assert secrets.find_spans("%25" * 50 + "%2525") == ([], [])
    assert secrets.find_spans(data.prose(random.Random(1), 3000)) == ([], [])


def test_percent_map_is_exact():
    text = "x pass%77ord=%61bcdefghijklmn y"
    assert secrets.find_spans(text)[1] == [("assign", 2, 29)]


def test_table(spark):
    rows = [*data.awkward(), data.row(900, "k " * 200_000 + SECRET)]
    got = secrets.scan_secrets(data.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [tuple(s) for s in next(r for r in got if r.doc_id == 900).base] == brute(rows[-1][1])
    assert secrets.scan_secrets(data.docs(spark, [])).count() == 0


SECRET = 'x token = "Zx81kq0PLm44vTTs9" y'


def kinds_of(text):
    return {k for k, _, _ in secrets.find_spans(text)[1]}


def wrapped(data, width=20):
    b = base64.b64encode(data).decode()
    return "\n".join(b[i : i + width] for i in range(0, len(b), width))


@pytest.mark.parametrize("text", [
    wrapped(SECRET.encode()), wrapped(gzip.compress((SECRET * 3).encode())), "key-" + base64.b64encode(SECRET.encode()).decode(), "https://h.example/r/" + base64.b64encode(SECRET.encode()).decode(),
    "dir/x/" + base64.b64encode(zlib.compress(SECRET.encode())).decode(), "".join(f"%{b:02x}" for b in gzip.compress(SECRET.encode())), "".join(f"\\x{b:02x}" for b in zlib.compress(SECRET.encode())),
    base64.b64encode(SECRET.encode("utf-16")).decode(), base64.b64encode(b"\0\x01" + SECRET.encode() + b"\xff").decode(), base64.b64encode(gzip.compress(b"none here") + gzip.compress(SECRET.encode())).decode(),
    base64.b64encode(bz2.compress(SECRET.encode())).decode(), base64.b64encode(lzma.compress(SECRET.encode())).decode(), base64.b64encode(zstandard.compress(SECRET.encode())).decode(),
    base64.b64encode(zlib.compress(base64.b64encode(gzip.compress(SECRET.encode())))).decode(),
])
def test_layers_are_opened_whole(text):
    assert secrets.scan(text) == [] and kinds_of("see " + text + " end") == {"assign"}


def test_long_streams_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1 << 16)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    body = b"lorem ipsum, dolor. " * 20_000
    for at in (0, 65_530, len(body)):
        data = body[:at] + SECRET.encode() + body[at:]
        for packed in (gzip.compress(data), bz2.compress(data), lzma.compress(data), zstandard.compress(data)):
            assert kinds_of(base64.b64encode(packed).decode()) == {"assign"}


def test_clean_runs_give_nothing():
    rng = random.Random(5)
    for _ in range(200):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(12, 400)))
        assert not kinds_of("id " + base64.b64encode(raw).decode() + " end") - {k for k, _, _ in secrets.scan(base64.b64encode(raw).decode())}
