"""Every query of the entry with SQL gives the same rows in Spark and in DuckDB; the others run."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from cellwise.plans import catalog  # noqa: E402
from tests.conftest import SF  # noqa: E402

if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(data):
    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return float(x) if hasattr(x, "quantize") else x

    return sorted(tuple(str(plain(x)) for x in r) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    got = rel.fetchall()
    assert rows(df.select(*(f"`{c}`" for c in cols)).collect()) == rows(tuple(r[rel.columns.index(c)] for c in cols) for r in got)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
