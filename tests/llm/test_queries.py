"""The registered queries over the smallest tables: against SQL, brute force or held-out accuracy."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graftwork.llm.oracles import ORACLES
from graftwork.llm.queries import QUERIES
from tests.llm import test_embeddup, test_neardup, test_secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())


def test_registered():
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(QUERIES) | {"pipeline"} <= set(known)
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_near_duplicates(spark):
    got = Counter(tuple(r) for r in QUERIES["op6_minhash_near_dedup"](spark, FOLDER).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == test_neardup.brute(documents(spark), 3, 85, 100)


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    import numpy as np

    m = np.array([x for _, x in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    got = {r.vec_id: r for r in QUERIES["op9_embedding_near_dedup"](spark, FOLDER).collect()}
    assert [got[i].n_links for i, _ in rows] == (link.sum(axis=1) - 1).tolist()
    assert test_embeddup.have  # the same brute force covers components there


def test_secrets_base(spark):
    texts = dict(documents(spark))
    for r in QUERIES["op8_secret_scans"](spark, FOLDER).collect():
        base = test_secrets.brute(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        import hashlib

        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[0] == k for b in base) for k in ("assign", "access", "hex"))
        assert set(line.split(",")) <= set(r.spans.split(",")) | {""}


def test_language_accuracy(spark):
    told = QUERIES["op10_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right = told.filter("held_out and lang_pred <> 'und'").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_decontamination_finds_whole_items(spark):
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_decontamination"](spark, FOLDER).collect()}
    held = {(d, i) for d, t in documents(spark) for i, x in items.items() if x in " ".join((t or "").lower().split())}
    assert held <= got


def test_model_beats_the_base(spark):
    r = QUERIES["op3_lm_scoring"](spark, FOLDER).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
