"""Each query against its SQL on the smallest tables."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

from tarnwork.plans import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, Number) and not isinstance(x, bool) else x
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    if name in SQL:
        assert _rows(found) == _rows(duck.sql(SQL[name]).df())
