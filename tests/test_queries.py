"""Every registered query runs on the smallest tables, and gives what its SQL gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cardsieve.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    try:
        return float(f"{float(v):.8g}")
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    result = duck.execute(registry.ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=2e-4))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL and n not in ("boosted_scores", "forest_scores")])
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
