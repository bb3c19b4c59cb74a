"""Python's packages wherever versions are ordered: fixes, safe targets, differences, releases. The SQL orders by the numbers that the versions are written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import advisories as A
from ..operators import changes as C
from ..operators import deps as D
from .scan_queries import table

#: Tails of versions and their rank: development, alpha, candidate, release, local label, post-release.
TAILS = (".dev1", "a2", "-RC.1", "", "+local.2", ".post1")
_RANKED = "['.dev1', 'a2', '-RC.1', '', '+local.2', '.post1']"


def _version(a, b, shape, tail):
    """Two, three or four numbers, of which only the first two differ from zero, and a tail."""
    body = F.concat(a.cast("string"), F.lit("."), b.cast("string"), F.element_at(F.array(F.lit(""), F.lit(".0"), F.lit(".0.0")), (shape % 3 + 1).cast("int")))
    return F.concat(body, F.element_at(F.array(*map(F.lit, TAILS)), (tail % 6 + 1).cast("int")))


def _held(spark, sf_dir):
    """What suppliers hold on even and on odd lines."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("lockfile"), F.lit("PyPI").alias("ecosystem"), (F.col("l_partkey") % 20).cast("string").alias("name"), _version(F.col("l_partkey") % 3, F.col("l_orderkey") % 12, F.col("l_orderkey"), F.col("l_partkey")).alias("version"), "l_linenumber")
    return tuple(rows.where(F.col("l_linenumber") % 2 == k).drop("l_linenumber") for k in (0, 1))


def python_diff(spark, sf_dir):
    return D.diff(*_held(spark, sf_dir)).groupBy("lockfile", "kind").agg(F.count("*").alias("n"), F.min("from_version").alias("first_from"), F.max("to_version").alias("last_to"))


def python_changed(spark, sf_dir):
    old, new = _held(spark, sf_dir)
    return C.changed(new, old).select("lockfile", "name", "version", "replaces")


def python_versions_by_name(spark, sf_dir):
    return C.versions_by_name(_held(spark, sf_dir)[0]).select("lockfile", "name", F.array_join("versions", ",").alias("versions"))


def _advised(spark, sf_dir):
    """A package a brand and size with an advisory of two lines of releases, 1.2 to 1.20 and 2.1 to 2.10."""
    p = table(spark, sf_dir, "part")
    packages = p.select(F.lit("PyPI").alias("ecosystem"), F.col("p_brand").alias("name"), _version(F.col("p_size") % 3, F.col("p_partkey") % 25, F.col("p_partkey"), F.col("p_size")).alias("version")).distinct()
    event = lambda kind, v: F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("version"))
    line = lambda low, high: F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event("introduced", low), event("fixed", high)).alias("events"))
    brands = p.select(V.normal_name(F.lit("PyPI"), F.col("p_brand")).alias("package_key")).distinct()
    entries = brands.select(F.lit("PyPI").alias("ecosystem"), "package_key", F.lit("P-1").alias("id"), F.array().cast("array<string>").alias("versions"), F.array(line("1.2", "1.20"), line("2.1", "2.10.0")).alias("ranges"))
    return packages, entries


def python_fixed_in(spark, sf_dir):
    """The fix of the release's own line, and the lowest above it in the first range."""
    found, _ = A.matches(*_advised(spark, sf_dir))
    own = V.fixed_after(F.col("version"), F.col("ranges"), F.col("ecosystem"))
    return found.select("name", "version", own.alias("fixed_in"), V.lowest_fix(F.col("version"), F.col("ranges")[0]["events"], F.col("ecosystem")).alias("lowest"))


def python_safe_targets(spark, sf_dir):
    packages, entries = _advised(spark, sf_dir)
    return A.safe_targets(A.matches(packages, entries)[0], entries).select("package_key", "current", "version")


def python_fix_lowest(spark, sf_dir):
    """The lowest fix above 1.5 by name."""
    p = table(spark, sf_dir, "part")
    fixed = F.when(F.col("p_partkey") % 5 > 0, _version(F.col("p_size") % 3, F.col("p_partkey") % 30, F.col("p_size"), F.col("p_partkey")))
    entries = p.select(F.lit("PyPI").alias("ecosystem"), F.col("p_brand").alias("name"), F.lit("1.5").alias("version"), fixed.alias("fixed"))
    return C.lowest_fix(entries).select("name", V.pep440_key(F.col("fix"))["kind"].alias("kind"), F.regexp_extract("fix", r"^\d+\.(\d+)", 1).alias("minor"), "without")


def _released(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("PyPI").alias("ecosystem"), F.col("o_custkey").alias("package"), _version(F.col("o_orderkey") % 2, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey")).alias("version"), F.col("o_orderpriority").alias("publisher"), "o_orderkey")


def python_previous(spark, sf_dir):
    rows = D.previous_release(D.earlier_publishers(_released(spark, sf_dir)))
    return rows.select("package", "version", "previous", F.array_join("earlier", ",").alias("earlier"))


def python_lowest_parent(spark, sf_dir):
    """The lowest release above 0.300 that admits 3.4.0 of what it needs."""
    admits = F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit(".0"))
    below = F.concat((F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(".0a1"))
    rows = _released(spark, sf_dir).select("ecosystem", F.col("package").alias("parent"), F.lit("0.300").alias("version"), F.col("version").alias("release"), F.lit("dep").alias("dep"), admits.alias("low"), below.alias("high"))
    return C.lowest_parent(rows, spark.createDataFrame([("dep", "3.4.0")], "dep string, target string")).select("parent", "to")


def _sql(a, b, shape, tail):
    """The version's text and its key."""
    return f"{a} || '.' || {b} || ['', '.0', '.0.0'][{shape} % 3 + 1] || {_RANKED}[{tail} % 6 + 1]", f"[{a}, {b}, {tail} % 6]"


_V, _K = _sql("l_partkey % 3", "l_orderkey % 12", "l_orderkey", "l_partkey")
_PAIR = f"""WITH rows AS (SELECT DISTINCT l_suppkey AS lockfile, CAST(l_partkey % 20 AS VARCHAR) AS name, {_V} AS version, {_K} AS k, l_linenumber % 2 AS side FROM lineitem),
old AS (SELECT * FROM rows WHERE side = 0), new AS (SELECT * FROM rows WHERE side = 1)"""
_AV, _AK = _sql("p_size % 3", "p_partkey % 25", "p_partkey", "p_size")
_HIT = f"""WITH v AS (SELECT DISTINCT p_brand AS name, {_AV} AS version, {_AK} AS k FROM part),
hit AS (SELECT * FROM v WHERE (k >= [1, 2, 3] AND k < [1, 20, 3]) OR (k >= [2, 1, 3] AND k < [2, 10, 3]))"""
_FV, _FK = _sql("p_size % 3", "p_partkey % 30", "p_size", "p_partkey")
_RV, _RK = _sql("o_orderkey % 2", "o_orderkey", "o_custkey", "o_orderkey")
_RELEASES = f"WITH r AS (SELECT o_custkey AS package, {_RV} AS version, {_RK} AS k, o_orderkey % 6 < 3 AS pre, o_orderpriority AS publisher, o_orderkey FROM orders)"
QUERIES = {f.__name__: f for f in (python_diff, python_changed, python_versions_by_name, python_fixed_in, python_safe_targets, python_fix_lowest, python_previous, python_lowest_parent)}
ORACLES = {
    "python_diff": _PAIR + """,
l AS (SELECT *, row_number() OVER (PARTITION BY lockfile, name ORDER BY k, version) AS n FROM old ANTI JOIN new USING (lockfile, name, version)),
r AS (SELECT *, row_number() OVER (PARTITION BY lockfile, name ORDER BY k, version) AS n FROM new ANTI JOIN old USING (lockfile, name, version))
SELECT coalesce(l.lockfile, r.lockfile) AS lockfile, CASE WHEN l.version IS NULL THEN 'Added' WHEN r.version IS NULL THEN 'Removed' WHEN r.k >= l.k THEN 'Upgraded' ELSE 'Downgraded' END AS kind,
       count(*) AS n, min(l.version) AS first_from, max(r.version) AS last_to
FROM l FULL JOIN r ON l.lockfile = r.lockfile AND l.name = r.name AND l.n = r.n GROUP BY 1, 2""",
    "python_changed": _PAIR + " SELECT n.lockfile, n.name, n.version, o.replaces FROM (SELECT * FROM new ANTI JOIN old USING (lockfile, name, version)) n LEFT JOIN (SELECT lockfile, name, max_by(version, (k, version)) AS replaces FROM old GROUP BY ALL) o ON n.lockfile = o.lockfile AND n.name = o.name",
    "python_versions_by_name": _PAIR + " SELECT lockfile, name, string_agg(version, ',' ORDER BY k, version) AS versions FROM old GROUP BY lockfile, name",
    "python_fixed_in": _HIT + " SELECT name, version, CASE k[1] WHEN 1 THEN '1.20' ELSE '2.10.0' END AS fixed_in, CASE k[1] WHEN 1 THEN '1.20' END AS lowest FROM hit",
    "python_safe_targets": _HIT + " SELECT lower(replace(name, '#', '#')) AS package_key, version AS current, t AS version FROM hit, unnest(['1.20', '2.10.0']) AS x(t) WHERE k[1] = 1 OR t = '2.10.0'",
    "python_fix_lowest": f"""WITH e AS (SELECT p_brand AS name, {_FK} AS k, p_partkey % 5 > 0 AS fixed FROM part),
a AS (SELECT name, CASE WHEN fixed AND k > [1, 5, 3] THEN k END AS k FROM e)
SELECT name, CASE min(k)[3] WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE CASE WHEN min(k) IS NOT NULL THEN 3 END END AS kind, CAST(min(k)[2] AS VARCHAR) AS minor, count(*) FILTER (k IS NULL) AS without FROM a GROUP BY name""",
    "python_previous": _RELEASES + """
SELECT package, version, CASE WHEN pre THEN lag(version) OVER w ELSE last_value(CASE WHEN NOT pre THEN version END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS previous,
       coalesce(array_to_string(list_sort(list_distinct(list(publisher) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), ','), '') AS earlier
FROM r WINDOW w AS (PARTITION BY package ORDER BY k)""",
    "python_lowest_parent": _RELEASES + """ SELECT package AS parent, min_by(version, k) AS "to" FROM r WHERE k > [0, 300, 3] AND NOT pre AND o_orderkey % 4 = 3 GROUP BY package""",
}
