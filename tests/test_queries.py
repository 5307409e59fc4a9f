"""Every registered query of the archive against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from keepsake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if hasattr(v, "__len__"):
        return tuple(map(value, v))
    return float(f"{float(v):.12g}")


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(value(r[k]) for k in order) for r in table), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_is_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracles()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_runs_again_alike(spark, sf, name):
    run = lambda: rows((df := registry.queries()[name](spark, sf)).columns, df.collect())
    first = run()
    assert first and first == run()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
