import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from graftwork.llm import decontam
from tests.llm import data

ITEMS = "item_id bigint, text string, id string"


def brute_tiles(doc, item, tile):
    """The textbook loop: look for the longest unmarked match, mark it, again."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not a[i + n] and not b[d + n]:
                    n += 1
                if n >= tile and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return out
        n, i, d = best
        a[i : i + n] = [True] * n
        b[d : d + n] = [True] * n
        out.append(best)


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_tiles_against_the_textbook(monkeypatch, held):
    monkeypatch.setattr(decontam, "MAX_PAIRS", held)
    rng = random.Random(4)
    for _ in range(300):
        doc = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        item = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        got = decontam.tiled(np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64), 3)
        assert got == brute_tiles(doc, item, 3), (doc, item)


def leaks():
    rng = random.Random(8)
    items = [(i, data.prose(rng, rng.randint(12, 50)), "x") for i in range(20)] + [(50, None, "x"), (51, "", "x"), (52, "one two three", "x")]
    rows = data.awkward()
    for i, t, _ in items[:20]:
        w = t.split()
        half = len(w) // 2
        rows += [
            data.row(500 + i, data.prose(rng, 300) + " " + t.upper() + ". " + data.prose(rng, 50)),
            data.row(600 + i, ", ".join(w[half:]) + "\n" + data.prose(rng, 80) + " " + " ".join(w[:half])),
            data.row(700 + i, data.prose(rng, 100) + " " + " ".join(w[: max(4, len(w) // 5)]) + " " + data.prose(rng, 100)),
        ]
    rows.append(data.row(800, "zero ONE, two; three. four"))
    return rows, items


def pairs(df):
    return Counter((r.id, r.item_id, r.n_tiles, r.covered, r.item_words) for r in df.collect())


def test_leaks_are_caught_and_short_quotes_left(spark):
    rows, items = leaks()
    docs, bench = data.docs(spark, rows), spark.createDataFrame(items, ITEMS)
    got = pairs(decontam.tile_pairs(spark, docs, bench))
    ids = {(i, k) for i, k, *_ in got}
    assert ids == {(500 + i, i) for i in range(20)} | {(600 + i, i) for i in range(20)} | {(800, 52)}
    assert pairs(decontam.tile_pairs(spark, docs, bench, max_words=0)) == got


def test_empty_tables(spark):
    rows, items = leaks()
    none = spark.createDataFrame([], ITEMS)
    assert decontam.tile_pairs(spark, data.docs(spark, rows), none).count() == 0
    assert decontam.tile_pairs(spark, data.docs(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert decontam.tile_pairs(spark, data.docs(spark, []), none, max_words=-1).count() == 0


def test_repetitive_texts_take_little_memory():
    doc, item = np.full(20_000, 7, dtype=np.uint64), np.full(2_000, 7, dtype=np.uint64)
    tracemalloc.start()
    assert decontam.tiled(doc, item, 3) == [(2000, 0, 0)]
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_running_hashes():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    words[30:40] = words[3:13]
    h = decontam.rolling(words, 5)
    assert len(h) == 46 and (h[30:36] == h[3:9]).all() and len(set(h.tolist())) == 40


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(9,2)"])
def test_ids_of_any_type(spark, kind, monkeypatch):
    text = "one two three four five six seven eight"
    items = spark.createDataFrame([(7, text)], "item_id int, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
    docs = spark.createDataFrame([("a", "x " + text), ("b", None), ("c", "nothing of it")], "doc_id string, text string")
    for limit in (decontam.MAX_WORDS, -1):
        got = decontam.tile_pairs(spark, docs, items, max_words=limit).collect()
        assert [(r.id, int(float(r.item_id)), r.covered) for r in got] == [("a", 7, 8)]
