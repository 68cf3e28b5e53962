"""Every registered query with SQL equals that SQL, run by another engine on the same files."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from reclink.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return int(x) if isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(value(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()]
    found = [tuple(value(x) for x in r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
