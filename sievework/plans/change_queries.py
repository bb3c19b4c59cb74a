"""Changes of lockfiles, their review and their fixes: lockfiles are suppliers, packages are parts, releases orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import names as M
from ..functions import versions as V
from ..operators import advisories as A
from ..operators import changes as C
from ..operators import deps as D
from ..operators import report as R
from .scan_queries import table

CUT = "1995-06-01"


def _packages(spark, sf_dir):
    """What suppliers hold before and from a day on."""
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_orderkey") % 5).cast("string"), F.lit("0"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lockfile"), (F.col("l_partkey") % 50).cast("string").alias("name"), version.alias("version"), "l_shipdate")
    return rows.where(F.col("l_shipdate") < CUT).drop("l_shipdate"), rows.where(F.col("l_shipdate") >= CUT).drop("l_shipdate")


def versions_by_name(spark, sf_dir):
    return C.versions_by_name(_packages(spark, sf_dir)[0]).select("lockfile", "name", F.array_join("versions", ",").alias("versions"))


def deps_changed(spark, sf_dir):
    old, new = _packages(spark, sf_dir)
    return C.changed(new, old)


def deps_changes_ordered(spark, sf_dir):
    return C.ordered(D.diff(*_packages(spark, sf_dir))).groupBy("lockfile", "kind").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("changes"))


def review_tally(spark, sf_dir):
    return C.tally(D.diff(*_packages(spark, sf_dir)))


def review_lines(spark, sf_dir):
    rows = R.review_lines(D.diff(*_packages(spark, sf_dir)))
    return rows.groupBy("lockfile", "kind").agg(F.min("line").alias("first"), F.max("line").alias("last"))


def findings_of_changed(spark, sf_dir):
    old, new = _packages(spark, sf_dir)
    findings = new.unionByName(old).select("name", "version").distinct().where("name % 2 = 0")
    return C.of_changed(findings, C.changed(new, old))


def _queries(spark, sf_dir):
    """Batches of a hundred parts; every ninth has no answer."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("batch"), (F.col("p_partkey") % 100).alias("at"), F.col("p_partkey").cast("string").alias("name"), F.lit("1.0.0").alias("version"), "p_partkey", "p_size")
    ids = F.when(F.col("p_size") % 3 == 0, F.array()).otherwise(F.array(F.concat(F.lit("A-"), F.col("p_size").cast("string")), F.concat(F.lit("A-"), (F.col("p_size") % 7).cast("string"))))
    return p.select("batch", "at", "name", "version"), p.where("p_partkey % 9 <> 0").select("batch", "at", ids.cast("array<string>").alias("ids"))


def advisory_positional(spark, sf_dir):
    rows, checks = C.positional(*_queries(spark, sf_dir))
    return rows.groupBy("batch").agg(F.sum(F.size("ids")).alias("n")).select("batch", F.lit("answered").alias("status"), "n").unionByName(checks.select("batch", "status", F.col("unanswered").alias("n")))


def advisories_by_package(spark, sf_dir):
    rows, _ = C.positional(*_queries(spark, sf_dir))
    details = table(spark, sf_dir, "part").select(F.concat(F.lit("A-"), F.col("p_size").cast("string")).alias("id"), F.when(F.col("p_size") < 10, "low").when(F.col("p_size") < 30, "high").alias("severity")).distinct().where("id <> 'A-1'")
    return C.by_query(rows, details).select("name", F.array_join("ids", ",").alias("ids"), "worst")


def ecosystems(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("ecosystem")).distinct()


def lockfile_unresolved(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lockfile"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("entry"), (F.col("l_quantity") > 2).alias("resolved"))
    return C.unresolved(li).select("lockfile", "unresolved", F.array_join("samples", ",").alias("samples"), "status")


def fix_parents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    bad = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return C.parents(edges, bad)


def fix_lowest_parent(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = lambda x: F.concat(x.cast("string"), F.lit(".0.0"))
    release = F.when(F.col("o_orderkey") % 7 == 0, F.concat(v(F.col("o_orderkey")), F.lit("-rc.1"))).otherwise(v(F.col("o_orderkey")))
    rows = o.select(
        F.col("o_custkey").alias("parent"), F.lit("5.0.0").alias("version"), release.alias("release"), F.lit("dep").alias("dep"), v(F.col("o_orderkey") % 4).alias("low"), v(F.col("o_orderkey") % 4 + 1).alias("high"),
    )
    targets = spark.createDataFrame([("dep", "2.1.0"), ("dep", "3.4.0")], "dep string, target string")
    return C.lowest_parent(rows, targets).select("parent", "to")


def _entries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fixed = F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("0")))
    return p.select(F.col("p_brand").alias("name"), F.lit("20.0.0").alias("version"), fixed.alias("fixed"))


def fix_lowest(spark, sf_dir):
    return C.lowest_fix(_entries(spark, sf_dir)).select("name", "fix", "without")


def fix_guidance(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bad = p.where("p_size < 20").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 4 != 0).alias("edges_known"), F.when(F.col("p_partkey") % 6 != 0, "9.0.0").alias("fix"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("parent")).distinct()
    allows = F.when((F.col("node") + F.col("parent")) % 3 == 0, True).when((F.col("node") + F.col("parent")) % 3 == 1, False)
    needs = li.join(bad.select("node"), "node", "left_semi").select("node", "parent", (F.col("parent") % 5 == 0).alias("member"), allows.alias("allows"))
    ups = li.where("parent % 2 = 0").select("parent", "node", F.lit("8.0.0").alias("to"))
    return C.guidance(bad, needs, ups).select("node", "fix", F.array_join("steps", ",").alias("steps"), "blocking", "unknown")


def deps_listing(spark, sf_dir):
    old, _ = _packages(spark, sf_dir)
    direct = old.where("version like '1.%'")
    return R.listing(old.distinct(), direct).groupBy("lockfile").agg(F.count("*").alias("packages"), F.min_by("text", "at").alias("first"), F.max_by("text", "at").alias("last"))


def name_pep508(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("My_Pkg."), k.cast("string"), F.lit(" [x,y] (>=1.0) ; python_version > '3'"))).when(k % 5 == 1, F.concat(F.lit("a"), k.cast("string"), F.lit("; extra == 'dev'"))).when(
        k % 5 == 2, F.concat(F.lit("b"), k.cast("string"), F.lit(" @ https://x/y"))).when(k % 5 == 3, "==1").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("~=2.1,<3")))
    r = M.pep508(text)
    return table(spark, sf_dir, "part").select("p_partkey", r["name"].alias("name"), r["spec"].alias("spec"))


def name_npm_range(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "npm:other@^1.2").when(k % 4 == 1, "npm:@scope/x@~3").when(k % 4 == 2, "npm:other").otherwise(F.concat(F.lit("^"), k.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", M.npm_range(text).alias("range"))


def integrity_digest(spark, sf_dir):
    k, hexes = F.col("p_partkey"), F.sha2(F.col("p_name").cast("binary"), 256)
    text = F.when(k % 4 == 0, F.concat(F.lit("SHA256:"), F.upper(hexes))).when(k % 4 == 1, F.concat(F.lit("sha256-"), F.base64(F.unhex(hexes)), F.lit(" sha1-x"))).when(k % 4 == 2, "md5:abc").otherwise("nothing")
    r = M.integrity(text)
    return table(spark, sf_dir, "part").select("p_partkey", r["alg"].alias("alg"), r["content"].alias("content"))


def purl_qualified(spark, sf_dir):
    k = F.col("p_partkey")
    eco = F.when(k % 4 == 0, "npm").when(k % 4 == 1, "PyPI").when(k % 4 == 2, "Go").otherwise("crates.io")
    kind = F.when(k % 3 == 0, "git").when(k % 3 == 1, "url").otherwise("registry")
    name = F.when(k % 4 == 0, F.concat(F.lit("@a b/n"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("My_Pkg."), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("x.y/z+"), k.cast("string"))).otherwise(F.concat(F.lit("c~"), k.cast("string")))
    url = F.when(k % 3 < 2, "https://h/é?a=1")
    return table(spark, sf_dir, "part").select("p_partkey", M.purl(eco, name, F.when(k % 5 == 0, "").otherwise("1.0+b"), kind, url, F.when(k % 2 == 0, "rev1")).alias("purl"))


def strict_dates(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("2024-02-"), F.lpad((k % 40).cast("string"), 2, "0"))).when(k % 3 == 1, F.concat(F.lit("2024-2-"), (k % 28 + 1).cast("string"))).otherwise("2024-02-01T00")
    return table(spark, sf_dir, "part").select("p_partkey", M.strict_date(text).cast("string").alias("day"))


def requirement_matrix(spark, sf_dir):
    """Six requirements on versions made of a part's size and key."""
    ship(spark)
    k, s = F.col("p_partkey"), F.col("p_size")
    eco = F.when(k % 6 < 2, "npm").when(k % 6 < 4, "crates.io").when(k % 6 == 4, "PyPI").otherwise("Go")
    spec = F.element_at(F.array(*map(F.lit, SPECS)), (k % 6 + 1).cast("int"))
    version = F.concat_ws(".", s.cast("string"), (k % 9).cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").select("p_partkey", V.requirement_allows(eco, spec, version).alias("allows"))


def advisory_pypi(spark, sf_dir):
    """Python versions of every shape, in ranges of each kind."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    base = F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"))
    version = F.concat(F.when(k % 2 == 0, base).otherwise(F.concat(base, F.lit(".0"))), F.element_at(F.array(*map(F.lit, TAILS)), (k % len(TAILS) + 1).cast("int")))
    packages = p.select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("Pkg_"), (k % 3).cast("string")).alias("name"), version.alias("version"), "p_size", "p_partkey")
    event = lambda kind, v: F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("version"))
    kind = F.element_at(F.array(F.lit("ECOSYSTEM"), F.lit("SEMVER"), F.lit("GIT")), F.col("id").cast("int") + 1)
    events = F.array(event("introduced", "0"), event("fixed", "1.20"), event("introduced", "1.30"), event("last_affected", "1.40.0"))
    entries = spark.range(3).select(
        F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg-"), F.col("id").cast("string")).alias("package_key"), F.concat(F.lit("P-"), F.col("id").cast("string")).alias("id"), F.array().cast("array<string>").alias("versions"),
        F.array(F.struct(kind.alias("type"), events.alias("events"))).alias("ranges"),
    )
    return A.judged(packages, entries).select("name", "version", "id", "hit")


#: Tails of versions, from the lowest: development, alpha, candidate, release, post-release.
TAILS = (".dev1", "a2", "-RC.1", "", ".post1", "+local.2")
SPECS = ("^10.2.0", "5 - 20.3", "~30.4", ">=7, <40", ">=12.1,!=15.3.0", "v1.0.0")
_PK = f"""WITH rows AS (
  SELECT l_suppkey AS lockfile, CAST(l_partkey % 50 AS VARCHAR) AS name, l_linenumber || '.' || l_orderkey % 5 || '.0' AS version, l_linenumber * 10 + l_orderkey % 5 AS k, l_shipdate FROM lineitem
),
old AS (SELECT DISTINCT lockfile, name, version, k FROM rows WHERE l_shipdate < TIMESTAMP '{CUT}'),
new AS (SELECT DISTINCT lockfile, name, version, k FROM rows WHERE l_shipdate >= TIMESTAMP '{CUT}')"""
_DIFF = _PK + """,
l AS (SELECT *, row_number() OVER (PARTITION BY lockfile, name ORDER BY k) AS n FROM old ANTI JOIN new USING (lockfile, name, version)),
r AS (SELECT *, row_number() OVER (PARTITION BY lockfile, name ORDER BY k) AS n FROM new ANTI JOIN old USING (lockfile, name, version)),
d AS (
  SELECT coalesce(l.lockfile, r.lockfile) AS lockfile, coalesce(l.name, r.name) AS name, l.version AS from_version, r.version AS to_version,
         CASE WHEN l.version IS NULL THEN 'Added' WHEN r.version IS NULL THEN 'Removed' WHEN r.k >= l.k THEN 'Upgraded' ELSE 'Downgraded' END AS kind
  FROM l FULL JOIN r ON l.lockfile = r.lockfile AND l.name = r.name AND l.n = r.n
)"""
_ASKED = """WITH q AS (
  SELECT p_partkey // 100 AS batch, CAST(p_partkey AS VARCHAR) AS name, p_size, p_partkey % 9 <> 0 AS answered FROM part
)"""

QUERIES = {f.__name__: f for f in (
    versions_by_name, deps_changed, deps_changes_ordered, review_tally, review_lines, findings_of_changed, advisory_positional, advisories_by_package, ecosystems, lockfile_unresolved, fix_parents, fix_lowest_parent,
    fix_lowest, fix_guidance, deps_listing, name_pep508, name_npm_range, integrity_digest, purl_qualified, strict_dates, requirement_matrix, advisory_pypi,
)}
ORACLES = {
    "versions_by_name": _PK + " SELECT lockfile, name, string_agg(version, ',' ORDER BY k) AS versions FROM old GROUP BY lockfile, name",
    "deps_changed": _PK + " SELECT n.lockfile, n.name, n.version, o.replaces FROM (SELECT lockfile, name, version FROM new ANTI JOIN old USING (lockfile, name, version)) n LEFT JOIN (SELECT lockfile, name, max_by(version, k) AS replaces FROM old GROUP BY ALL) o ON n.lockfile = o.lockfile AND n.name = o.name",
    "deps_changes_ordered": _DIFF + """,
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lockfile ORDER BY CASE kind WHEN 'Added' THEN 1 WHEN 'Upgraded' THEN 2 WHEN 'Downgraded' THEN 3 ELSE 4 END) AS INT) AS nth FROM d)
SELECT lockfile, kind, min(nth) AS first, max(nth) AS last, count(*) AS changes FROM n GROUP BY lockfile, kind""",
    "review_tally": _DIFF + " SELECT lockfile, count(*) FILTER (kind = 'Added') AS added, count(*) FILTER (kind = 'Upgraded') AS upgraded, count(*) FILTER (kind = 'Downgraded') AS downgraded, count(*) FILTER (kind = 'Removed') AS removed FROM d GROUP BY lockfile",
    "review_lines": _DIFF + """,
t AS (SELECT *, CASE kind WHEN 'Added' THEN '+ ' || name || ' ' || to_version WHEN 'Removed' THEN '- ' || name || ' ' || from_version ELSE CASE kind WHEN 'Upgraded' THEN '^ ' ELSE 'v ' END || name || ' ' || from_version || ' -> ' || to_version END AS line FROM d)
SELECT lockfile, kind, min(line) AS first, max(line) AS last FROM t GROUP BY lockfile, kind""",
    "findings_of_changed": _PK + " SELECT DISTINCT name, version FROM (SELECT * FROM new ANTI JOIN old USING (lockfile, name, version)) WHERE CAST(name AS INT) % 2 = 0",
    "advisory_positional": _ASKED + " SELECT batch, 'answered' AS status, CAST(sum(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS n FROM q WHERE answered GROUP BY batch UNION ALL SELECT batch, 'incomplete', count(*) FROM q WHERE NOT answered GROUP BY batch",
    "advisories_by_package": _ASKED + """,
i AS (SELECT DISTINCT name, unnest(['A-' || p_size, 'A-' || p_size % 7]) AS id FROM q WHERE answered AND p_size % 3 <> 0),
d AS (SELECT DISTINCT 'A-' || p_size AS id, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 3 ELSE 4 END AS rank FROM part WHERE p_size <> 1)
SELECT name, string_agg(i.id, ',' ORDER BY i.id) AS ids, CAST(max(coalesce(rank, 4)) AS INT) AS worst FROM i LEFT JOIN d ON i.id = d.id GROUP BY name""",
    "ecosystems": "SELECT DISTINCT regexp_extract(p_type, '^([A-Z]+)', 1) AS ecosystem FROM part",
    "lockfile_unresolved": """WITH e AS (SELECT l_suppkey AS lockfile, l_orderkey || '-' || l_linenumber AS entry FROM lineitem WHERE NOT l_quantity > 2),
n AS (SELECT *, row_number() OVER (PARTITION BY lockfile ORDER BY entry) AS nth FROM e)
SELECT lockfile, count(*) AS unresolved, string_agg(entry, ',' ORDER BY entry) FILTER (WHERE nth <= 3) AS samples, 'incomplete' AS status FROM n GROUP BY lockfile""",
    "fix_parents": "SELECT DISTINCT 'p' || l_partkey AS node, 's' || l_suppkey AS parent FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7",
    "fix_lowest_parent": """SELECT o_custkey AS parent, min(o_orderkey) || '.0.0' AS "to" FROM orders WHERE o_orderkey > 5 AND o_orderkey % 7 <> 0 AND o_orderkey % 4 IN (2, 3) GROUP BY o_custkey""",
    "fix_lowest": """WITH e AS (SELECT p_brand AS name, CASE WHEN p_partkey % 5 <> 0 AND (p_size > 20 OR (p_size = 20 AND p_partkey % 7 > 0)) THEN p_size * 10 + p_partkey % 7 END AS k, p_size || '.' || p_partkey % 7 || '.0' AS v FROM part)
SELECT name, min_by(v, k) AS fix, count(*) FILTER (k IS NULL) AS without FROM e GROUP BY name""",
    "fix_guidance": """WITH b AS (SELECT p_partkey AS node, p_partkey % 4 <> 0 AS edges_known, CASE WHEN p_partkey % 6 <> 0 THEN '9.0.0' END AS fix FROM part WHERE p_size < 20),
n AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS parent, (l_partkey + l_suppkey) % 3 AS a FROM lineitem),
s AS (
  SELECT node, count(*) FILTER (a = 1) AS blocking, count(*) FILTER (a = 2) AS unknown,
         array_to_string(list_sort(list(DISTINCT CASE WHEN parent % 5 = 0 THEN 'raise' WHEN parent % 2 = 0 THEN 'upgrade' ELSE 'override' END) FILTER (a = 1)), ',') AS steps FROM n GROUP BY node
)
SELECT b.node, fix, CASE WHEN fix IS NULL THEN 'none' WHEN NOT edges_known THEN 'refresh' ELSE coalesce(nullif(steps, ''), 'refresh') END AS steps,
       CASE WHEN fix IS NULL OR NOT edges_known THEN 0 ELSE coalesce(blocking, 0) END AS blocking, CASE WHEN fix IS NULL OR NOT edges_known THEN 0 ELSE coalesce(unknown, 0) END AS unknown
FROM b LEFT JOIN s ON b.node = s.node""",
    "deps_listing": _PK + """,
p AS (SELECT DISTINCT lockfile, name FROM old WHERE version LIKE '1.%'),
t AS (SELECT o.lockfile, o.name, o.version, o.name || '@' || o.version || CASE WHEN p.name IS NULL THEN '' ELSE ' direct' END AS text FROM old o LEFT JOIN p ON o.lockfile = p.lockfile AND o.name = p.name)
SELECT lockfile, count(*) AS packages, min_by(text, (name, version)) AS first, max_by(text, (name, version)) AS last FROM t GROUP BY lockfile""",
    "name_pep508": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'my-pkg-' || p_partkey WHEN 4 THEN 'c' || p_partkey END AS name, CASE p_partkey % 5 WHEN 0 THEN '>=1.0' WHEN 4 THEN '~=2.1,<3' END AS spec FROM part",
    "name_npm_range": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '^1.2' WHEN 1 THEN '~3' WHEN 2 THEN '*' ELSE '^' || p_partkey END AS range FROM part",
    "integrity_digest": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'SHA-256' END AS alg, CASE WHEN p_partkey % 4 < 2 THEN sha256(p_name) END AS content FROM part",
    "purl_qualified": """SELECT p_partkey, 'pkg:' || CASE p_partkey % 4 WHEN 0 THEN 'npm/%40a%20b/n' || p_partkey WHEN 1 THEN 'pypi/my-pkg-' || p_partkey WHEN 2 THEN 'golang/x.y/z%2B' || p_partkey ELSE 'cargo/c~' || p_partkey END
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '@1.0%2Bb' END
  || CASE p_partkey % 3 WHEN 0 THEN '?vcs_url=https%3A%2F%2Fh%2F%C3%A9%3Fa%3D1' || CASE WHEN p_partkey % 2 = 0 THEN '%40rev1' ELSE '' END WHEN 1 THEN '?download_url=https%3A%2F%2Fh%2F%C3%A9%3Fa%3D1' ELSE '' END AS purl FROM part""",
    "strict_dates": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(TRY_CAST('2024-02-' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) END AS day FROM part",
    "advisory_pypi": """WITH v AS (
  SELECT p_partkey % 3 AS i, p_size, p_partkey % 6 AS t, '1.' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.0' END || ['.dev1', 'a2', '-RC.1', '', '.post1', '+local.2'][p_partkey % 6 + 1] AS version FROM (SELECT DISTINCT ON (p_partkey % 3, p_size, p_partkey % 2, p_partkey % 6) * FROM part)
)
SELECT 'Pkg_' || i AS name, version, 'P-' || i AS id, CASE i WHEN 2 THEN false WHEN 1 THEN NULL
  ELSE p_size < 20 OR (p_size = 20 AND t < 3) OR (p_size > 30 AND p_size < 40) OR (p_size = 30 AND t >= 3) OR (p_size = 40 AND t <= 3) END AS hit FROM v""",
    "requirement_matrix": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size = 10 AND p_partkey % 9 >= 2 WHEN 1 THEN p_size BETWEEN 5 AND 19 OR (p_size = 20 AND p_partkey % 9 <= 3) WHEN 2 THEN p_size = 30 AND p_partkey % 9 = 4 WHEN 3 THEN p_size BETWEEN 7 AND 39
  WHEN 4 THEN (p_size > 12 OR (p_size = 12 AND p_partkey % 9 >= 1)) AND NOT (p_size = 15 AND p_partkey % 9 = 3) ELSE true END AS allows FROM part""",
}
