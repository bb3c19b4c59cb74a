"""Queries over lineitem read all of it."""

from pathlib import Path

import duckdb
import pytest
from test_queries import bag

from sievework.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
CUT = ["patch_lines", "patch_files", "patch_complexity", "lcov_totals", "lcov_lines", "deps_diff", "bom_components"]


@pytest.mark.parametrize("name", CUT)
def test_all_of_lineitem(spark, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    assert "key <=" not in ORACLES[name]
    df = QUERIES[name](spark, SF)
    theirs = con.execute(ORACLES[name])
    assert bag(df.columns, map(tuple, df.collect())) == bag([d[0] for d in theirs.description], theirs.fetchall())


def test_every_order_and_supplier(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    for name, key, of in (("patch_lines", "patch", "l_orderkey"), ("patch_files", "patch", "l_orderkey"), ("lcov_totals", "report", "l_suppkey"), ("lcov_lines", "report", "l_suppkey"), ("deps_diff", "lockfile", "l_suppkey")):
        assert QUERIES[name](spark, SF).select(key).distinct().count() == items.select(of).distinct().count(), name
