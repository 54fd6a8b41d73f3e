"""Every query with SQL against DuckDB, and the registration."""

import duckdb
import pytest

import __spark_entry__ as E
from redline.llm.queries import ORACLE, QUERIES
from redline.sources.tables import TABLES, table_path
from tests.util import canon


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    df = QUERIES[name](spark, sf)
    got = canon(df.columns, df.collect())
    r = con.execute(ORACLE[name])
    assert got == canon([d[0] for d in r.description], r.fetchall())
