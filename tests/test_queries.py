import glob
import os

import pytest

import __spark_entry__ as entry
from vazante.plans.oracle import ORACLE_SQL
from vazante.plans.queries import QUERIES


def shown(value):
    if value is None:
        return "null"
    return repr(round(float(value), 6)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in order) for r in df.collect()) == want


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
