import random

import numpy as np
from pyspark.sql import functions as F

from graftwork.llm import langid
from tests.llm import data

SYLLABLES = {"aa": ["tha", "ing", "er", "ou"], "bb": ["eau", "tré", "çon", "oi"], "cc": ["sch", "ung", "ü", "keit"]}


def labelled(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(15, 60)))
        out.append((i, text.upper() if i % 9 == 0 else text, lang))
    return out


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    prototypes = langid.fit_prototypes(docs.filter(langid.learnable(F.col("doc_id"))))
    got = langid.identify(docs.filter(~langid.learnable(F.col("doc_id"))), prototypes).collect()
    assert len(got) > 30 and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)


def test_cosine_is_that_of_the_summed_grams():
    enc = langid.Encoder()
    codes = [ord(c) for c in " ab c "]
    total = sum(np.roll(enc.letter(a), 2) * np.roll(enc.letter(b), 1) * enc.letter(c) for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert np.allclose(enc.encode("  Ab, 7\nC!"), total / np.linalg.norm(total), atol=1e-6)


def test_a_text_of_more_grams_than_the_table(monkeypatch):
    monkeypatch.setattr(langid, "MAX_GRAMS", 50)
    small = langid.Encoder().encode(data.prose(random.Random(2), 400))
    monkeypatch.undo()
    assert np.allclose(small, langid.Encoder().encode(data.prose(random.Random(2), 400)), atol=1e-5)


def test_awkward_rows(spark):
    docs = data.docs(spark).withColumn("score", F.lit("x"))
    prototypes = langid.fit_prototypes(docs)
    got = langid.identify(docs, prototypes).collect()
    assert len(got) == len(data.awkward())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    empty = data.docs(spark, [])
    assert langid.identify(empty, langid.fit_prototypes(empty)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(labelled(), "doc_id bigint, text string, lang string")
    assert set(langid.fit_prototypes(docs, max_per_lang=5)) <= set(SYLLABLES)
