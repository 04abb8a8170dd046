from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graftwork.llm import linededup
from graftwork.llm.common import Scratch
from tests.llm import data

WHITE = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, keep):
    held = defaultdict(set)
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if key := line.strip(WHITE).translate(UP):
                held[key].add(i)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    out = []
    for i, r in enumerate(rows):
        lines = (r[1] or "").split("\n")
        left = []
        for line in lines:
            key = line.strip(WHITE).translate(UP)
            hot = key and len(held[key]) >= least
            if hot and keep == "first":
                hot = order(min(held[key], key=order)) != order(i)
            if not hot:
                left.append(line)
        out.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


def rows():
    out = [data.row(i, f"Home | About\n text {i}\n\tHOME | about \r\n\nÉa") for i in range(12)]
    out += [data.row(i, f"rare line\nonly {i}") for i in range(20, 24)]
    out += [data.row(30, "rare line"), data.row(30, "rare line"), data.row(None, "home | about\nx"), data.row(31, "\u00a0home | about")]
    return out + data.awkward()


def test_against_brute_force(spark):
    for keep in ("none", "first"):
        for least in (3, 10):
            got = linededup.dedup_lines(spark, data.docs(spark, rows()), min_docs=least, keep=keep, bucketed=least == 10)
            assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute(rows(), least, keep), (keep, least)


def test_columns_pass_and_clashes_are_replaced(spark):
    docs = data.docs(spark, rows()).withColumn("n_lines", F.lit("old")).withColumn("h", F.lit(b"x")).withColumn("first", F.lit(1))
    got = linededup.dedup_lines(spark, docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"} and dict(got.dtypes)["n_lines"] == "bigint"
    assert got.count() == len(rows())


def test_empty_table(spark):
    assert linededup.dedup_lines(spark, data.docs(spark, [])).count() == 0


def test_runs_compact_into_levels(spark):
    runs = linededup.LineRuns(Scratch(spark, "t"), min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([x]), (False, b)) for x in range(b, b + 3)], "h binary, first struct<none:boolean,id:bigint>"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h[0]: (r.n, r["first"].id) for r in runs.repeated().collect()} == {2: (3, 0), 3: (3, 1), 4: (3, 2)}


def test_way_beyond_the_bound_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MAX_HOT", -1)
    docs = data.docs(spark, rows()).withColumns({"_gw_a": F.lit(1), "_GW_DROP": F.lit(2), "a": F.lit(3)})
    for keep in ("none", "first"):
        got = linededup.dedup_lines(spark, docs, min_docs=3, keep=keep)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute(rows(), 3, keep)


def test_ids_that_are_no_numbers(spark):
    docs = data.docs(spark, rows()).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    runs = lambda: {x.name for x in spark.catalog.listTables() if x.name.startswith("run_")}
    before = runs()
    got = linededup.dedup_lines(spark, docs, min_docs=3)
    assert sorted(r.text or "" for r in got.collect()) == sorted(t for (_, _, _, t), n in brute(rows(), 3, "none").items() for _ in range(n))
    assert runs() == before
