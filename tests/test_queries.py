"""Every registered query of the engine agrees with its SQL at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from codefacts import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY_AT_ANY_SCALE = {"u06_disjoint_plans"}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NA or x != x:
            return "NULL"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(round(x, 6)) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, con, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_but_one_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"w05_trace_violations"}


def test_entry_runs(spark, con):
    import __spark_entry__ as e

    assert e.entry(spark).count() == con.sql("SELECT DISTINCT l_orderkey // 20 FROM lineitem").shape[0]
    assert set(e.oracle_sql()) <= set(e.queries())
