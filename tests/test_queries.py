"""Every query outside the training-data subpackage against its SQL, as the driver compares."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomspark.plans import catalogue


def normal(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(zip(*([text(x) for x in df[c].tolist()] for c in sorted(df.columns))))


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, tables, name):
    mine = catalogue.queries()[name](spark, data).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(mine) > 0
        return
    theirs = tables.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
