"""Each query against its SQL in DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v)


@pytest.mark.parametrize("name", ENGINE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = duck.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in out.fetchall())


def test_education_at_institutions_named_like_years(spark, duck, tmp_path):
    """Customer keys of larger tables look like years."""
    keys = ", ".join(f"({o}, {c})" for c in (1899, 1900, 1999, 2018, 2099, 2100, 20180, 12345678) for o in range(6 * c, 6 * c + 6))
    duck.execute(f"COPY (SELECT o::BIGINT AS o_orderkey, c::BIGINT AS o_custkey FROM (VALUES {keys}) t(o, c)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    df = entry.queries()["education_fragment_merge"](spark, str(tmp_path))
    sql = f"WITH orders AS (SELECT * FROM read_parquet('{tmp_path}/orders.parquet')) {entry.oracle_sql()['education_fragment_merge']}"
    out = duck.execute(sql)
    assert df.columns == [c[0] for c in out.description]
    assert sorted(map(tuple, df.collect())) == sorted(out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
