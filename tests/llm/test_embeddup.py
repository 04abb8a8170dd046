import math

import numpy as np

from graftwork.llm import embeddup

ROWS = "vec_id bigint, embedding array<float>, label int, `row` int, v int"


def vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    at = n
    for size, noise in ((2, 0.05), (2, 0.05), (3, 0.08), (40, 0.04), (90, 0.01), (60, 0.075)):
        base = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((at, (base + noise * rng.standard_normal(dim)).tolist()))
            at += 1
    same = rng.standard_normal(dim).tolist()
    rows += [(at, same), (at + 1, same), (at + 2, same), (at + 2, same)]
    rows += [(at + 10, None), (at + 11, [0.0] * dim), (at + 12, [1.0] * (dim - 1) + [None]), (at + 13, [1.0] * (dim - 1) + [math.inf]), (at + 14, [math.nan] * dim), (at + 15, [1.0] * 3), (at + 16, []), (None, same)]
    return [(*r, 1, 2, 3) for r in rows]


def brute(rows, threshold):
    dim = 16
    good = [x is not None and len(x) == dim and None not in x and np.isfinite(x).all() and any(x) for _, x, *_ in rows]
    m = np.array([np.asarray(x, dtype=np.float32).astype(float) if g else np.zeros(dim) for (_, x, *_), g in zip(rows, good)])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    link = (m @ m.T >= threshold) & np.array(good)[:, None] & np.array(good)
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(label, np.where(link, label, len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((r[0], int(link[i].sum()), least, r[0] == least))
    return sorted(out, key=str)


def have(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = vectors()
    assert have(embeddup.near_vectors(spark, spark.createDataFrame(rows, ROWS), 0.95)) == brute(rows, 0.95)


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 32)
    monkeypatch.setattr(embeddup, "CHUNK", 16)
    rows = vectors(1)
    assert have(embeddup.near_vectors(spark, spark.createDataFrame(rows, ROWS), 0.95)) == brute(rows, 0.95)


def test_empty_and_unusable_tables(spark):
    assert embeddup.near_vectors(spark, spark.createDataFrame([], ROWS)).count() == 0
    got = embeddup.near_vectors(spark, spark.createDataFrame([(1, None, 1, 1, 1), (2, [0.0], 1, 1, 1)], ROWS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def tight_pairs(n, dim=16, seed=5):
    """Three pairs of clusters of n distinct near copies: cosine about 0.999 inside one, 0.965 across a pair."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(3):
        a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
        for centre in (a, 0.965 * a + math.sqrt(1 - 0.965**2) * b):
            rows += [(centre + 0.006 * rng.standard_normal(dim)).tolist() for _ in range(n)]
    rows += [v.tolist() for v in rng.standard_normal((200, dim))]
    return [(i, x, 1, 2, 3) for i, x in enumerate(rows)]


def test_tight_clusters_that_fill_every_list_are_linked(spark):
    rows = tight_pairs(40)
    assert have(embeddup.near_vectors(spark, spark.createDataFrame(rows, ROWS), 0.95)) == brute(rows, 0.95)


def test_tight_clusters_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 32)
    monkeypatch.setattr(embeddup, "THIN", 8)
    rows = tight_pairs(150)
    assert have(embeddup.near_vectors(spark, spark.createDataFrame(rows, ROWS), 0.95)) == brute(rows, 0.95)
