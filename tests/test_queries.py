"""Every query against its SQL on the smallest tables."""

import math
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    """Rows in an order that does not depend on the engine, floats to six digits."""

    def value(v):
        if v is None or v is pd.NA or (isinstance(v, (float, np.floating)) and math.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return int(v)
        if isinstance(v, (float, np.floating)):  # whole numbers beside nulls come as floats from one engine
            return int(v) if float(v).is_integer() else round(float(v), 6)
        return str(v)

    return sorted((tuple(map(value, row)) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    got, expected = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
