"""Registered queries against their SQL twins on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from cellweek.catalog.forecast_oracles import FORECAST_ORACLES
from cellweek.catalog.oracles import ORACLES
from cellweek.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")

# Every twin of this part of the library; the operators of the other part are tested there.
CHECKED = sorted({**ORACLES, **FORECAST_ORACLES})


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def ordered(rows, names, columns):
    place = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=repr)


# What has no rows in the smallest tables, where no points cluster.
EMPTY = {"cluster_ids", "cluster_pages", "cluster_report_json", "cluster_summary"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_twin(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    found = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = ordered(df.collect(), df.columns, columns)
    assert got == ordered(found.fetchall(), names, columns)
    assert got or name in EMPTY


def test_entry_and_names(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(CHECKED) == set(QUERIES)
