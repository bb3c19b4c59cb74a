"""Versions, ranges, requirements, licences."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import licenses as L
from sievework.functions import versions as V
from sievework.functions.ranges import allows


def test_semver_precedence(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0", "v2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(V.semver_key(F.col("v")))
    assert [r["v"] for r in df.collect()] == order
    assert spark.createDataFrame([("latest",)], "v string").select(V.semver_key(F.col("v")).isNull().alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("version", "events", "want"),
    [
        ("1.5.0", [("introduced", "0"), ("fixed", "1.6.0")], True),
        ("1.6.0", [("introduced", "0"), ("fixed", "1.6.0")], False),
        ("1.6.0", [("introduced", "1.0.0"), ("last_affected", "1.6.0")], True),
        ("1.6.1", [("introduced", "1.0.0"), ("last_affected", "1.6.0")], False),
        ("3.0.0", [("fixed", "1.6.0"), ("introduced", "2.0.0"), ("introduced", "0")], True),
        ("x", [("introduced", "0")], None),
        ("1.0.0", [("introduced", "y")], None),
    ],
)
def test_in_range(spark, version, events, want):
    df = spark.createDataFrame([(version, events)], "v string, e array<struct<kind:string,version:string>>")
    assert df.select(V.in_range(F.col("v"), F.col("e")).alias("x")).first()["x"] is want


@pytest.mark.parametrize(
    ("eco", "requirement", "version", "want"),
    [
        ("npm", "^1.2.0", "1.9.9", True), ("npm", "^1.2.0", "2.0.0", False), ("npm", "^0.2.3", "0.3.0", False), ("npm", "~2.1", "2.1.9", True), ("npm", "~2.1", "2.2.0", False), ("npm", "1.x || 3.*", "3.4.5", True),
        ("npm", "1.0.0 - 2.0.0", "2.0.0", True), ("npm", ">=1.0.0 <2.0.0", "2.0.0", False), ("npm", "*", "9.9.9", True), ("npm", "nonsense!", "1.0.0", None), ("npm", "^1.0.0", "1.5.0-beta", False),
        ("npm", "1.2.3", "1.2.3", True), ("npm", "1.2.3", "1.2.4", False), ("npm", ">1.2.3", "1.2.3", False), ("npm", "<=1.2.3", "1.2.3", True),
        ("crates.io", "1.2", "1.9.0", True), ("crates.io", "=1.2.3", "1.2.4", False), ("crates.io", ">=1, <2", "1.5.0", True), ("PyPI", ">=1.0,<2", "1.5", True), ("PyPI", "^1.2", "1.9", True), ("PyPI", "~=1.4.2", "1.5.0", False),
        ("PyPI", "1.0", "1.0.0", True), ("PyPI", ">>1", "1.0", None), ("Go", "v1.2.3", "v1.9.0", True),
    ],
)
def test_requirements(eco, requirement, version, want):
    assert allows(eco, requirement, version) is want


@pytest.mark.parametrize(
    ("text", "deny", "allow", "want"),
    [
        ("MIT OR GPL-3.0", ["GPL-3.0"], [], "allowed"), ("MIT AND GPL-3.0-only", ["GPL-3.0"], [], "denied"), ("(MIT OR GPL-2.0) AND AGPL-3.0", ["AGPL-3.0"], [], "denied"), ("GPL-2.0 WITH Classpath", ["GPL-2.0"], [], "denied"),
        ("Apache-2.0", [], ["MIT"], "denied"), ("MIT", [], ["mit"], "allowed"), ("MIT OR", [], [], "unknown"), (None, [], [], "unknown"),
    ],
)
def test_license_verdicts(text, deny, allow, want):
    assert L.judge(text, deny, allow)[0] == want
