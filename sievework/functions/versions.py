"""Versions as comparable columns, and ranges over them, with unknown as null throughout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SEMVER = r"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def _groups(version: Column, pattern: str, n: int, key) -> Column:
    """key of the function that gives a pattern's groups, the pattern being matched once; null for what it doesn't match."""
    found = F.when(version.rlike(pattern), F.split(F.regexp_replace(version, pattern, "".join(f"${i}\x1f" for i in range(1, n + 1))), "\x1f", -1))
    return F.transform(F.array(found), lambda g: F.when(g.isNotNull(), key(lambda i: g[i - 1])))[0]


def semver_key(version: Column) -> Column:
    """A struct that compares as SemVer precedence does; null for what is no version. Build metadata doesn't count.

    Releases stand above pre-releases; numeric identifiers below others, and a shorter list of them below a longer one."""
    identifier = lambda x: F.struct(
        (~x.rlike("^[0-9]+$")).alias("text"), F.when(x.rlike("^[0-9]+$"), x.cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)")).alias("number"), F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("word")
    )

    def key(part) -> Column:
        pre = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(part(4), r"\."))
        return F.struct(
            *(part(i).cast("decimal(20,0)").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))),
            (part(4) == "").alias("release"),
            F.transform(pre, identifier).alias("pre"),
        )

    return _groups(version, SEMVER, 5, key)


def is_pre(version: Column, ecosystem: Column | None = None) -> Column:
    """Whether a version is a pre-release, or one of Python's development releases."""
    semver = F.when(version.rlike(SEMVER), F.regexp_extract(version, SEMVER, 4) != "")
    if ecosystem is None:
        return semver
    python = F.when(version.rlike(PEP440), (F.regexp_extract(version, PEP440, 3) != "") | (F.regexp_extract(version, PEP440, 8) != ""))
    return F.when(ecosystem == "PyPI", python).otherwise(semver)


# Fixed value: the grammar of Python's versions, in its groups epoch, release, kind and number of a pre-release, two ways to write a post-release, development release and local label.
PEP440 = (
    r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def pep440_key(version: Column) -> Column:
    """A struct that compares as Python's versions do; null for what is none. Trailing zeros of a release don't count; a
    development release is below its pre-releases, those below the release, and that below its post-releases; a local label is above its public version."""
    number = lambda x: F.when(x == "", 0).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)")
    whole = lambda x: x.rlike("^[0-9]+$")

    def key(part) -> Column:
        release = F.transform(F.split(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\."), lambda x: x.cast("decimal(20,0)"))
        post, dev = (part(5) != "") | (part(6) != ""), part(8) != ""
        kind = F.when(part(3).isin("a", "alpha"), 0).when(part(3).isin("b", "beta"), 1).when(part(3) != "", 2).when(dev & ~post, -1).otherwise(3)
        label = F.when(part(10) == "", F.array().cast("array<string>")).otherwise(F.split(part(10), "[-_.]"))
        local = F.transform(label, lambda x: F.struct(whole(x).alias("number"), F.when(whole(x), x.cast("decimal(20,0)")).alias("value"), F.when(whole(x), "").otherwise(x).alias("word")))
        return F.struct(
            number(part(1)).alias("epoch"),
            release.alias("release"),
            kind.alias("kind"),
            number(part(4)).alias("pre"),
            F.when(post, number(F.concat(part(5), part(7)))).otherwise(-1).cast("decimal(20,0)").alias("post"),
            (~dev).alias("final"),
            number(part(9)).alias("dev"),
            local.alias("local"),
        )

    return _groups(F.lower(version), PEP440, 10, key)


def order_key(version: Column, ecosystem: Column | None = None) -> Column:
    """A struct that compares as the ecosystem's versions do: Python's by their own rules, all others, and those of no stated ecosystem, by SemVer. Keys of one ecosystem compare; null for what is no version."""
    semver = semver_key(version)
    if ecosystem is None:
        return semver
    python = pep440_key(version)
    mine = lambda p: F.when(p.isNotNull(), F.struct(F.lit(None).cast("int").alias("_"), p.alias("python"), F.when(F.lit(False), semver).alias("semver")))
    other = lambda s: F.when(s.isNotNull(), F.struct(F.lit(None).cast("int").alias("_"), F.when(F.lit(False), python).alias("python"), s.alias("semver")))
    # A key is made once and then named, as each mention would make it again.
    return F.when(ecosystem == "PyPI", F.transform(F.array(python), mine)[0]).otherwise(F.transform(F.array(semver), other)[0])


def stated(rows: DataFrame) -> Column | None:
    """The rows' ecosystem, where they state one."""
    return F.col("ecosystem") if "ecosystem" in rows.columns else None


def in_range(version: Column, events: Column, order=semver_key) -> Column:
    """Whether events (array of struct<kind, version>) have the version affected: introduced turns on from there, fixed off
    from there, last_affected off after it; "0" comes before all; limit is ignored. Null if a version can't be read."""
    key = order(version)
    keyed = F.transform(
        F.filter(events, lambda e: e["kind"] != "limit"),
        lambda e, i: F.struct(F.when((e["version"] == "0") & (e["kind"] == "introduced"), 0).otherwise(1).alias("first"), order(e["version"]).alias("key"), i.alias("i"), e["kind"].alias("kind")),
    )
    unread = key.isNull() | F.exists(keyed, lambda e: (e["first"] == 1) & e["key"].isNull())
    step = lambda on, e: (
        F.when((e["kind"] == "introduced") & ((e["first"] == 0) | (key >= e["key"])), True).when((e["kind"] == "fixed") & ((e["first"] == 0) | (key >= e["key"])), False).when((e["kind"] == "last_affected") & (key > e["key"]), False).otherwise(on)
    )
    folded = F.aggregate(F.array_sort(keyed), F.lit(False), step)
    return F.when(~unread, folded)


def affects(version: Column, versions: Column, ranges: Column, ecosystem: Column | None = None) -> Column:
    """Whether an entry names the version, or a range of it other than GIT holds it: true, false or null for undecidable.
    Python's packages order by their own rules, unless a range says SEMVER."""
    bare = F.regexp_replace(version, "^v", "")
    named = F.exists(F.coalesce(versions, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, "^v", "") == bare)
    held = lambda r: in_range(version, r["events"])
    if ecosystem is not None:
        held = lambda r: F.when((ecosystem == "PyPI") & (r["type"] != "SEMVER"), in_range(version, r["events"], pep440_key)).otherwise(in_range(version, r["events"]))
    ranged = F.exists(F.filter(ranges, lambda r: r["type"] != "GIT"), held)
    return named | F.coalesce(ranged, F.when(ranges.isNull() | (F.size(ranges) == 0), F.lit(False)))


def lowest_fix(version: Column, events: Column, ecosystem: Column | None = None) -> Column:
    """The lowest fixed version above this one."""
    k = lambda v: order_key(v, ecosystem)
    fixes = F.filter(events, lambda e: (e["kind"] == "fixed") & (k(e["version"]) > k(version)))
    return F.array_min(F.transform(fixes, lambda e: F.struct(k(e["version"]).alias("key"), e["version"].alias("version"))))["version"]


def fixed_after(version: Column, ranges: Column, ecosystem: Column) -> Column:
    """The lowest fix above a version in the ranges (struct<type, events>) other than GIT that hold it or can't be judged: the fix of its own line of releases.

    Where none is above it and a version couldn't be read, the first fix of all ranges."""
    own = F.filter(ranges, lambda r: r["type"] != "GIT")
    held = F.filter(own, lambda r: F.coalesce(F.when((ecosystem == "PyPI") & (r["type"] != "SEMVER"), in_range(version, r["events"], pep440_key)).otherwise(in_range(version, r["events"])), F.lit(True)))
    k = lambda v, r: order_key(v, F.when(r["type"] == "SEMVER", F.lit("")).otherwise(ecosystem))
    fixes = F.flatten(F.transform(held, lambda r: F.transform(F.filter(r["events"], lambda e: e["kind"] == "fixed"), lambda e: F.struct(k(e["version"], r).alias("key"), e["version"].alias("version"), k(version, r).alias("now")))))
    best = F.array_min(F.filter(fixes, lambda f: f["key"] > f["now"]))["version"]
    unread = F.exists(fixes, lambda f: f["key"].isNull()) | F.exists(held, lambda r: k(version, r).isNull())
    first = F.filter(F.flatten(F.transform(ranges, lambda r: r["events"])), lambda e: e["kind"] == "fixed")
    return F.coalesce(best, F.when(unread & (F.size(first) > 0), F.get(first, F.lit(0))["version"]))


def normal_name(ecosystem: Column, name: Column) -> Column:
    """PyPI names fold case and runs of marks; others stand."""
    folded = F.lower(F.regexp_replace(F.regexp_replace(name, "^[-_.]+|[-_.]+$", ""), "[-_.]+", "-"))
    return F.when(ecosystem == "PyPI", folded).otherwise(name)


def requirement_allows(ecosystem: Column, requirement: Column, version: Column) -> Column:
    """Whether a requirement (npm, Cargo, PEP 440, Go) admits a version; null where either can't be read."""

    @F.pandas_udf(BooleanType())
    def run(kinds: pd.Series, specs: pd.Series, versions: pd.Series) -> pd.Series:
        from sievework.functions.ranges import allows

        read = lambda k, s, v: allows(k, s, v) if s is not None and v is not None else None
        return pd.Series([read(*x) for x in zip(kinds, specs, versions, strict=True)], dtype="object")

    return run(ecosystem, requirement, version)
