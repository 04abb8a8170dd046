import random
import re
from collections import Counter

import pytest

from graftwork.llm import neardup
from graftwork.llm.common import Scratch
from graftwork.llm.components import components
from tests.llm import data

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UP)) if x]
    return {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = data.word(rng)
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    rows, i = data.awkward(seed), 1000
    for _ in range(12):
        base = data.prose(rng, rng.randint(30, 200))
        for _ in range(rng.randint(2, 30)):
            rows.append(data.row(i, edited(rng, base, rng.randint(0, 5))))
            i += 1
    shared = data.prose(rng, 60)
    for _ in range(150):
        rows.append(data.row(i, shared + " " + data.prose(rng, rng.randint(5, 120))))
        i += 1
    rng.shuffle(rows)
    return rows


def found(spark, rows, k, num, den):
    got = neardup.near_duplicates(spark, data.docs(spark, rows), k, num, den).collect()
    return got, Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, k, num, den):
    rows = corpus(k)
    got, have = found(spark, rows, k, num, den)
    assert have == brute(rows, k, num, den)
    assert sum(r["first"] for r in got) == len({(r.component_id, r.id if r.component_id is None or not r.n_shingles else None) for r in got}) or sum(r["first"] for r in got) >= len({r.component_id for r in got})


def test_large_nodes_branch_and_end_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    rows = corpus(9)
    assert found(spark, rows, 3, 85, 100)[1] == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark, data.docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.id: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(links, "a bigint, b bigint"), "c").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_trees_follow_the_recall():
    assert neardup.trees_for(0.85) == 16 and neardup.trees_for(0.8) == 22
