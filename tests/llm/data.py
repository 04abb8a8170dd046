"""Awkward rows that every operator has to take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, `row` int, rep int"
VOWELS = "aeiou"


def word(rng):
    return "".join(rng.choice("bcdfghklmnprst") + rng.choice(VOWELS) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def row(i, text, lang="en"):
    return (i, text, lang, None, None, "clash", 1, 2)


def awkward(seed=0):
    rng = random.Random(seed)
    long_text = prose(rng, 30_000)
    rows = [row(None, None, None), row(1, None), row(2, ""), row(3, " \n\t\n "), row(4, "a"), row(5, "one two"), row(5, "one two")]
    rows += [row(6, long_text), row(7, long_text), row(None, "no id but some text here"), row(8, "1234 !!! ---")]
    base = prose(rng, 120).split()
    for i in range(10, 40):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = word(rng)
        rows.append(row(i, " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :])))
    rows += [row(i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "fr", None])) for i in range(50, 90)]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)
