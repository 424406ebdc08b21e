"""Every registered query on the smallest tables, against its DuckDB SQL
(or, for model jobs, a row-count check); plus the driver entry point."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from versewise.plans import queries
from versewise.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
# the training-data queries have tests of their own
NAMES = sorted(queries.queries())
SQL = queries.oracle_sql()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if isinstance(v, str) else repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["vibe", "n_songs", "mean_word_count", "mean_kw_love_romance"] and rows


def test_every_query_is_registered_and_has_sql():
    assert set(NAMES) == set(SQL) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, rows) == canon(cols, res.fetchall())
