"""Orders of versions by ecosystem: the fixes of a release's own line, pre-releases, and versions of any length."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import versions as V
from sievework.operators import changes as C
from sievework.operators import deps as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ranges(*lines, kind="ECOSYSTEM"):
    event = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version"))
    return F.array(*(F.struct(F.lit(kind).alias("type"), F.array(event("introduced", a), event("fixed", b)).alias("events")) for a, b in lines))


@pytest.mark.parametrize(
    ("version", "lines", "ecosystem", "want"),
    [
        ("1.2", [("0", "1.20")], "PyPI", "1.20"),
        ("3.2", [("3.0", "3.2.19"), ("4.0", "4.2")], "PyPI", "3.2.19"),
        ("4.1", [("3.0", "3.2.19"), ("4.0", "4.2")], "PyPI", "4.2"),
        ("4.2", [("3.0", "3.2.19"), ("4.0", "4.2")], "PyPI", None),
        ("1.0.0.0", [("0", "1.0.0.1")], "PyPI", "1.0.0.1"),
        ("1.2.0", [("0", "1.20.0")], "npm", "1.20.0"),
        ("1.2", [("0", "1.20.0")], "npm", "1.20.0"),  # unreadable: the first fix
        ("1.2.0", [("0", "2.0.0"), ("1.0.0", "1.3.0")], "npm", "1.3.0"),
    ],
)
def test_fixed_after(spark, version, lines, ecosystem, want):
    assert one(spark, V.fixed_after(F.lit(version), ranges(*lines), F.lit(ecosystem))) == want


def test_lowest_fix_and_git_ranges(spark):
    assert one(spark, V.lowest_fix(F.lit("3.2"), ranges(("0", "3.2.19"))[0]["events"], F.lit("PyPI"))) == "3.2.19"
    assert one(spark, V.fixed_after(F.lit("3.2"), ranges(("0", "abc"), kind="GIT"), F.lit("PyPI"))) is None


def test_down_is_down(spark):
    rows = lambda *v: spark.createDataFrame([("l", "PyPI", "p", x) for x in v], "lockfile string, ecosystem string, name string, version string")
    got = {(r["from_version"], r["to_version"], r["kind"]) for r in D.diff(rows("3.2"), rows("3.1")).collect()}
    assert got == {("3.2", "3.1", "Downgraded")}
    assert D.diff(rows("1.9"), rows("1.10")).first()["kind"] == "Upgraded"
    assert C.changed(rows("2.0"), rows("1.9", "1.10", "1.10rc1")).first()["replaces"] == "1.10"


def test_prereleases(spark):
    for v, want in (("1.0rc1", True), ("1.0.dev1", True), ("1.0.post1", False), ("1.0", False), ("x", None)):
        assert one(spark, V.is_pre(F.lit(v), F.lit("PyPI"))) is want
