"""Every query with oracle SQL against DuckDB, on the smallest tables; the others must run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return str(x) if isinstance(x, str | bool) else f"{float(x):.9g}"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert a == b


def test_every_part_is_a_reference(spark):
    parts = {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    pairs = catalog.QUERIES["product_matching"](spark, SF).select("l", "r").collect()
    assert {p.l for p in pairs} == {p.r for p in pairs} == parts


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
