"""Every query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from driftmap.plans import context, mining
from driftmap.session import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = mining.QUERIES | context.QUERIES
ORACLE = mining.ORACLE | context.ORACLE


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)



def ordered(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is not None, x or "") for x in t))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = ordered(df.columns, df.collect())
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert found == ordered(columns, r.fetchall())
    else:
        assert found


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cochange_all", "volatility_percentile", "rank_anchors", "plan_rerun_select"])
def test_partitioning_does_not_matter(spark, name, monkeypatch):
    df = QUERIES[name](spark, SF)
    first = ordered(df.columns, df.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = QUERIES[name](spark, SF)
        assert ordered(again.columns, again.collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
