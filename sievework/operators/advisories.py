"""Packages against advisories: an equi join on ecosystem and name, then three-valued version tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import versions as V

# Fixed value: severities from the least; an unknown one counts as critical against a threshold.
RANK = {"low": 1, "moderate": 2, "medium": 2, "high": 3, "critical": 4}


def judged(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """packages x entries of the same ecosystem and name, with ``hit``: true, false, or null for undecidable."""
    keyed = packages.dropDuplicates(["ecosystem", "name", "version"]).withColumn("package_key", V.normal_name(F.col("ecosystem"), F.col("name")))
    return keyed.join(entries, ["ecosystem", "package_key"]).withColumn("hit", V.affects(F.col("version"), F.col("versions"), F.col("ranges"), F.col("ecosystem")))


def matches(packages: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, checks): a package with any undecidable entry is an incomplete check, not a pass, and its hits stand."""
    rows = judged(packages, entries)
    checks = rows.where("hit is null").groupBy("ecosystem", "name", "version").agg(F.count("*").alias("undecided"))
    return rows.where("hit"), checks.withColumn("status", F.lit("incomplete"))


def ignored(findings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, suppressed) by a list of advisory ids, case aside."""
    key = F.upper(findings["id"]) == F.upper(ids["ignored_id"])
    return findings.join(ids, key, "left_anti"), findings.join(ids, key, "left_semi")


def merge_aliases(group: pd.DataFrame) -> pd.DataFrame:
    """Advisories of one package that share an id or alias, merged in the order of their ids: known severity and first fix stay."""
    out: list[dict] = []
    for r in group.sort_values("id").to_dict("records"):
        names = {r["id"], *(r["aliases"] if r["aliases"] is not None else ())}
        same = next((o for o in out if o["names"] & names), None)
        if same is None:
            out.append({**r, "names": names})
        else:
            same["names"] |= names
            same["severity"] = same["severity"] if same["severity"] else r["severity"]
            same["fixed_in"] = same["fixed_in"] if same["fixed_in"] else r["fixed_in"]
    rows = [{**o, "aliases": sorted(o["names"] - {o["id"]})} for o in out]
    return pd.DataFrame(rows, columns=["package", "version", "id", "severity", "fixed_in", "aliases"])


def merged(advisories: DataFrame) -> DataFrame:
    """One row an advisory under all its names; a group is one package version's few advisories."""
    ship(advisories.sparkSession)
    schema = "package string, version string, id string, severity string, fixed_in string, aliases array<string>"
    return advisories.select("package", "version", "id", "severity", "fixed_in", "aliases").groupBy("package", "version").applyInPandas(merge_aliases, schema)


def at_least(severity, threshold: str):
    """Whether a severity reaches the threshold; unknown ones do."""
    rank = F.lit(RANK["critical"])
    for k, v in RANK.items():
        rank = F.when(F.lower(severity) == k, v).otherwise(rank)
    return rank >= RANK[threshold]


def safe_targets(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """For each affected package the versions that fix something, lie above it, and that no entry affects."""
    fixed = findings.select("ecosystem", "package_key", "version", F.explode(F.flatten(F.transform("ranges", lambda r: F.filter(r["events"], lambda e: e["kind"] == "fixed")))).alias("e"))
    above = fixed.where(V.order_key(F.col("e.version"), F.col("ecosystem")) > V.order_key(F.col("version"), F.col("ecosystem"))).select("ecosystem", "package_key", F.col("version").alias("current"), F.col("e.version").alias("version")).distinct()
    bad = above.join(entries, ["ecosystem", "package_key"]).where(F.coalesce(V.affects(F.col("version"), F.col("versions"), F.col("ranges"), F.col("ecosystem")), F.lit(True))).select("ecosystem", "package_key", "current", "version")
    return above.join(bad.distinct(), ["ecosystem", "package_key", "current", "version"], "left_anti")
