"""The queries of this package that SQL can express, against that SQL."""

import duckdb
import pytest

from driftmap.llm import queries
from tests.test_queries import SF, ordered


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(x[0] for x in r.description)
    assert ordered(df.columns, df.collect()) == ordered([x[0] for x in r.description], r.fetchall())
