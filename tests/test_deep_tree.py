"""Chains are followed however deep a tree is."""

import pytest

from sievework.operators import deps


def test_why_beyond_32_levels(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(36)] + [("n36", "n00")], "src string, dst string")
    found = deps.why(spark, edges, spark.createDataFrame([("n00",)], "node string"))
    assert {r["node"]: r["depth"] for r in found.select("node", "depth").collect()} == {f"n{i:02}": i for i in range(37)}


def test_recursive_query_has_no_silent_bound(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    edges.createOrReplaceTempView("deep_edges")
    spark.createDataFrame([("n0",)], "node string").createOrReplaceTempView("deep_roots")
    rows = spark.sql(deps.why_sql("deep_edges", "deep_roots")).collect()
    assert {r["node"]: r["depth"] for r in rows} == {f"n{i}": i for i in range(41)}
    spark.createDataFrame([("n0", "n1"), ("n1", "n0")], "src string, dst string").createOrReplaceTempView("deep_edges")
    with pytest.raises(Exception, match="RECURSION"):
        spark.sql(deps.why_sql("deep_edges", "deep_roots")).collect()
