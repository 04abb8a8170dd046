import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graftwork.llm import packing
from graftwork.llm.queries import vocabulary
from tests.llm import data


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    rows = data.awkward()
    got = packing.pack(spark, data.docs(spark, rows), vocabulary(), 256).toPandas()
    tok = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, s in enumerate(range(0, len(ids), 256)):
            piece = ids[s : s + 256]
            want[(-1 if r[0] is None else r[0], p, s, len(piece), zlib.crc32(piece.tobytes()))] += 1
    have = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert Counter(map(tuple, have.to_numpy().tolist())) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 256
    assert got["sequence_id"].nunique() <= least_bins(Counter(got["length"].tolist()), 256) * 11 / 9 + 1


def least_bins(counts, capacity):
    return max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))


def test_empty_table(spark):
    assert packing.pack(spark, data.docs(spark, []), vocabulary()).count() == 0


def test_chunk_tokenizer_is_exact():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(vocabulary()), packing.ChunkTokenizer(vocabulary())
    texts = ("It's  a\u00a0b\u2003c\u0301 e\u0301", "<|endoftext|> x<|startoftext|>y", "", " ", "\n\n", "\x1c\x1f a\x85b", "ÉÀ ÇÇ 12 3,4", "a\u0301 \u0301b", "ΑΣ Σ")
    assert list(own.encode(texts)) == [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_words_go_to_the_merges_as_the_library_sends_them():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    tok, own = Tokenizer.from_file(vocabulary()), packing.ChunkTokenizer(vocabulary())
    assert own.in_chunks
    bits = [chr(c) for c in range(33, 127)] + [chr(c) for c in range(161, 256)] + ["'s", "'ll", "n't", "<|endoftext|>", "the", "Über", "İ", "Σ", "\u0301", "²", "\u00ad", "\x7f", "\x85", "ﬁ", "12"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) + " " + data.prose(rng, 3) for _ in range(4000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_other_vocabularies_are_left_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, tok = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    assert not own.in_chunks and list(own.encode([" a  b\n"])) == [np.array(tok.encode(" a  b\n", add_special_tokens=False).ids, dtype="<u4").tobytes()]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    patterns, total = packing.plan(counts, 100)
    used = Counter()
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 100 and times > 0
        for n, k in pattern.items():
            used[n] += k * times
    assert used == counts and total == sum(t for _, t in patterns)
    assert total <= least_bins(counts, 100) * 11 / 9 + 1


def test_the_exchange_fits_two_more_tightly():
    # greedy takes 60 + 30 of 100; 30 goes for 22 + 18
    left = np.zeros(101, dtype=np.int64)
    for n in (60, 30, 22, 18):
        left[n] += 1
    assert packing.best_two(left, Counter({60: 1, 30: 1}), 10) == (30, 18, 22)


def test_plan_is_bounded_by_lengths():
    counts = {n: 10**9 + n for n in range(1, 2049)}
    patterns, total = packing.plan(counts)
    tokens = sum(n * c for n, c in counts.items())
    assert len(patterns) < 3 * 2048 and total < tokens / 2048 * 1.01


def test_a_megabyte_of_texts_is_held_at_a_time():
    pulled = 0

    def texts():
        nonlocal pulled
        for i in range(3500):
            pulled += 1
            yield f"{i} word " * 100

    assert next(packing.ChunkTokenizer(vocabulary()).encode(texts())) and pulled < 1500


def test_a_task_gives_its_memory_back():
    import psutil

    from graftwork.llm.common import released

    def run(batches):
        held = [bytes(600) for _ in range(300_000)]
        kept.append(bytes(600))  # lies behind them in the heap
        yield from batches
        held.clear()

    kept, whole, used = [], psutil.Process().memory_info, []
    for batch in released(run)(iter(["batch"])):
        assert batch == "batch"
        used.append(whole().rss)
    assert whole().rss < used[0] - (100 << 20)
