"""Every query of the catalog against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return columns, sorted(tuple(map(show, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows_of(catalog.queries()[name](spark, sf).toPandas()) == rows_of(duck.execute(catalog.oracle_sql()[name]).df())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
