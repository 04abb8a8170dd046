"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from graftwork.plans import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(value):
    if value is None or value != value:
        return ""
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return str([shown(v) for v in value])
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def rows(records, columns):
    return sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, str(FOLDER))
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows([r.asDict() for r in got.collect()], names) == rows([dict(zip(names, r)) for r in want.fetchall()], names)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
