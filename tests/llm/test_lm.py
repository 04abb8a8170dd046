import math
import random
import zlib
from collections import Counter

import numpy as np

from graftwork.llm import lm
from tests.llm import data


def base(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        ws = tokens(r[1])
        out.append((r[0], held(r[0]), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)))
    return sorted(out, key=str)


def test_counts_and_base_score(spark):
    rows = data.awkward()
    got = lm.score_texts(spark, data.docs(spark, rows)).collect()
    assert sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows)
    assert all(r.score < 0 for r in got)


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        letters = ("bcd", "fgh", "klm")[i % 3]
        words = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(80)]
        rows.append(data.row(i, " ".join(words)))
    got = [r for r in lm.score_texts(spark, data.docs(spark, rows)).collect() if r.held_out]
    assert len(got) > 50 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = rng.standard_normal((lm.ROWS, lm.CLASSES)).astype(np.float32)
    rows = lm.features(np.array([0, 0, 0, 3, 4, 5, 0]), np.array([0, 0, 0, 7, 8, 9, 0], dtype=np.uint64), np.arange(3, 7))
    bias = np.zeros(lm.CLASSES, dtype=np.float32)
    total = sum(np.exp(lm.class_logs(w, bias, rows, np.full(4, c))) for c in range(lm.CLASSES))
    assert rows.shape == (4, lm.FEATURES) and np.allclose(total, 1, atol=1e-4) and lm.ROWS < 1 << 16


def test_chunks_split_without_changing_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 500)
    rows = data.awkward()
    got = lm.score_texts(spark, data.docs(spark, rows)).collect()
    assert sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows)


def test_empty_table(spark):
    assert lm.score_texts(spark, data.docs(spark, [])).count() == 0


def test_each_ending_is_hashed_once(monkeypatch):
    calls, plain = [], lm.ending
    monkeypatch.setattr(lm, "ending", lambda w: calls.append(w) or plain(w))
    v = lm.Vocabulary("", np.arange(lm.ENDINGS) % lm.CLASSES)
    v.at, v.count, v.kind, v.hash = {b"": 0}, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint64)
    v._learn({b"walking", b"talking", b"king", b"a"})
    assert len(calls) == 2 and all(v.kind[i] == (plain(w) % lm.CLASSES if w else 0) for w, i in v.at.items())


def test_a_step_adds_the_gradients_of_each_row():
    rng = np.random.default_rng(4)
    rows, targets = np.asfortranarray(rng.integers(0, 9, (500, lm.FEATURES)).astype(np.uint16)), rng.integers(0, lm.CLASSES, 500)
    start, bias = rng.standard_normal((lm.ROWS, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, dtype=np.float32)
    t = lm.Trainer(start, bias)
    t.step(rows, targets)
    z = start[rows].astype(np.float64).sum(axis=1)
    g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(lm.CLASSES)[targets]
    want, square = start.astype(np.float64), np.full(lm.ROWS, 0.1)
    for j in range(lm.FEATURES):
        total = np.zeros(start.shape)
        np.add.at(total, rows[:, j], g)
        square += (total**2).sum(axis=1)
        want -= lm.RATE / np.sqrt(square)[:, None] * total
    assert np.allclose(t.weights, want, atol=1e-4) and t.met.sum() == rows.size


def test_texts_are_split_in_one_pass(spark):
    got = lm.score_texts(spark, data.docs(spark))
    later = spark.read.parquet(*got.inputFiles())
    assert "text" not in later.columns and dict(later.dtypes)["words"] == "binary" and got.count() == len(data.awkward())


def test_split_and_numbers_give_back_the_words(tmp_path, monkeypatch):
    rng = random.Random(3)
    # controls and bytes that other splitters take for space, in and out of letters
    some = lambda n: bytes(rng.choice(b"aAzZ b\t\n\x0b\x0c\r\x00\x1c\x1f\x85\xa0\xc3\xa9") for _ in range(n))
    texts = [b"", b"  ", b"One", some(1), b"", *(some(rng.randint(0, 40)) for _ in range(300)), b" end", b""]
    ends = np.cumsum([0, *map(len, texts)])
    ws, n = lm.split(memoryview(b"".join(texts)), ends[:-1])
    assert ws.to_pylist() == [w for t in texts for w in t.lower().split()] and n.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(lm, "PIECE_BYTES", 7)
    for t in [*texts[:20], b"no_space" * 9, b"one two  three " * 30]:
        writer = lm.ChunkWriter(str(tmp_path))
        i, n = writer.add(memoryview(t), np.zeros(1, dtype=np.int64), np.array([False]))
        back, want = list(writer.words.at), t.lower().split()
        assert [back[x] for x in i] == want and n.tolist() == [len(want)] and writer.words.count.sum() == len(want)
        assert writer.follows.sum() == max(len(want) - 1, 0) and all(writer.follows[lm.ending(a) * lm.ENDINGS + lm.ending(b)] for a, b in zip(want, want[1:]))


def test_endings_follow_only_inside_training_texts(tmp_path):
    writer = lm.ChunkWriter(str(tmp_path))
    writer.add(memoryview(b"aa bbcc dd ee"), np.array([0, 5, 5]), np.array([False, False, True]))
    assert np.flatnonzero(writer.follows).tolist() == [lm.ending(b"aa") * lm.ENDINGS + lm.ending(b"bb")]
    assert dict(zip(writer.words.at, writer.words.count.tolist())) == {b"": 0, b"aa": 1, b"bb": 1, b"cc": 0, b"dd": 0, b"ee": 0}
