import random

from pyspark.sql import functions as F

import corpus_pipeline
from graftwork.llm import decontam
from tests.llm import data

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, rows):
    rng = random.Random(6)
    items = [(i, data.prose(rng, 30)) for i in range(5)]
    rows = rows and [*rows, (9001, data.prose(rng, 40) + " " + items[2][1], "en", "s", 1)]
    spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(7)
    rows = [r[:5] for r in data.awkward()]
    menu = "home about contact imprint"
    rows += [next(r for r in rows if r[0] == 10)] * 2
    rows += [(2000 + i, f"{menu}\n{data.prose(rng, 60)}", "en", "s", 9) for i in range(15)]
    tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
    first, second, third, last = seen
    assert not {2, 3, 8} & set(first) and 6 in first
    assert menu in second[2000].text and all(menu not in second[2000 + i].text for i in range(1, 15))
    assert all(r.n_chars == len(r.text) for r in second.values())
    assert 6 in third and 7 not in third and docs.filter("doc_id = 10").count() == 1
    assert 9001 in third and 9001 not in last
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_both_ways_of_dropping_flagged_rows(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path, [r[:5] for r in data.awkward()])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    monkeypatch.setattr(corpus_pipeline, "MAX_BROADCAST", -1)
    monkeypatch.setattr(decontam, "MAX_WORDS", 0)
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == one


def test_empty_table(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.col("sequence_id")).schema
