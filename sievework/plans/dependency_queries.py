"""Versions, advisories, dependency trees and releases, over relations projected from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import licenses as L
from ..functions import versions as V
from ..operators import advisories as A
from ..operators import deps as D
from .scan_queries import table

def _packages(spark, sf_dir):
    """One package a part: its brand as name, and a version of its size and key."""
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("0"))
    version = F.when(F.col("p_partkey") % 11 == 0, F.concat(version, F.lit("-rc.1"))).when(F.col("p_partkey") % 13 == 0, F.lit("latest")).otherwise(version)
    return table(spark, sf_dir, "part").select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version"), "p_partkey")


def _entries(spark, sf_dir):
    """Advisories on brands whose number is even: affected from size 10 up to the fix in 30."""
    event = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version"))
    ranges = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(event("introduced", "10.0.0"), event("fixed", "20.0.0"), event("introduced", "25.1.0"), event("fixed", "30.0.0")).alias("events")))
    brands = table(spark, sf_dir, "part").where(F.regexp_extract("p_brand", "([0-9])$", 1).cast("int") % 2 == 0).select("p_brand").distinct()
    return brands.select(
        F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("package_key"), F.concat(F.lit("ADV-"), "p_brand").alias("id"), F.lit("high").alias("severity"), F.array(F.lit("v1.0.0"), F.lit("2.3.0")).alias("versions"), ranges.alias("ranges")
    )


def advisory_match(spark, sf_dir):
    rows = A.judged(_packages(spark, sf_dir), _entries(spark, sf_dir))
    return rows.select("name", "version", "id", "hit")


def advisory_checks(spark, sf_dir):
    return A.matches(_packages(spark, sf_dir), _entries(spark, sf_dir))[1].select("name", "version", "undecided", "status")


def advisory_fixed_in(spark, sf_dir):
    found, _ = A.matches(_packages(spark, sf_dir), _entries(spark, sf_dir))
    return found.select("name", "version", V.lowest_fix(F.col("version"), F.col("ranges")[0]["events"]).alias("fixed_in"))


def advisory_safe_targets(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    found, _ = A.matches(_packages(spark, sf_dir), entries)
    return A.safe_targets(found, entries).select("package_key", "current", "version")


def advisory_ignored(spark, sf_dir):
    found, _ = A.matches(_packages(spark, sf_dir), _entries(spark, sf_dir))
    ids = table(spark, sf_dir, "part").where("p_size < 3").select(F.lower(F.concat(F.lit("ADV-"), "p_brand")).alias("ignored_id")).distinct()
    open_, gone = A.ignored(found, ids)
    return open_.agg(F.count("*").alias("n")).select(F.lit("open").alias("kind"), "n").unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("ignored").alias("kind"), "n"))


def advisory_aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_brand").alias("package"), F.lit("1.0.0").alias("version"), F.format_string("A-%05d", "p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, "high").alias("severity"), F.when(F.col("p_partkey") % 2 == 0, "2.0.0").alias("fixed_in"),
        F.array(F.concat(F.lit("C-"), F.col("p_size").cast("string"))).alias("aliases"),
    )
    return A.merged(rows).select("package", "id", "severity", "fixed_in", F.array_join("aliases", ",").alias("aliases"))


def version_order(spark, sf_dir):
    rows = _packages(spark, sf_dir).select("name", "version", V.semver_key(F.col("version")).alias("k"))
    return rows.groupBy("name").agg(F.max_by("version", "k").alias("highest"), F.min_by("version", "k").alias("lowest"))


def _releases(spark, sf_dir):
    """One package a customer, one release an order; every fifth is a pre-release."""
    v = F.concat_ws(".", F.lit("1"), F.col("o_orderkey").cast("string"), F.lit("0"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("package"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(v, F.lit("-beta"))).otherwise(v).alias("version"), F.col("o_orderkey").alias("n"),
        F.col("o_orderpriority").alias("publisher"), F.col("o_orderdate").alias("published"), (F.col("o_totalprice") > 200000).alias("install_script"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("provenance"), F.when(F.col("o_orderkey") % 97 == 0, "yanked").alias("withdrawn"),
    )


def release_previous(spark, sf_dir):
    return D.previous_release(_releases(spark, sf_dir)).select("package", "version", "previous")


def release_publishers(spark, sf_dir):
    return D.earlier_publishers(_releases(spark, sf_dir)).select("package", "version", F.array_join("earlier", ",").alias("earlier"))


def release_signals(spark, sf_dir):
    rows = D.previous_release(D.earlier_publishers(_releases(spark, sf_dir)))
    old = rows.select("package", F.col("version").alias("previous"), F.col("install_script").alias("previous_install_script"), F.col("provenance").alias("previous_provenance"))
    joined = rows.join(old, ["package", "previous"], "left")
    return D.release_signals(joined, F.lit("1998-08-01 00:00:00").cast("timestamp")).groupBy("rule").agg(F.count("*").alias("n"))


def deps_diff(spark, sf_dir):
    """Lockfiles are suppliers, packages are parts; what they hold before and from 1995 on."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("lockfile"), (F.col("l_partkey") % 50).alias("name"), F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_orderkey") % 5).cast("string"), F.lit("0")).alias("version"), "l_shipdate"
    )
    cut = F.lit("1995-06-01").cast("timestamp")
    return D.diff(rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut)).groupBy("lockfile", "name", "kind").agg(F.count("*").alias("changes"), F.min("to_version").alias("least"))


def _tree(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        t("nation").select(name("region-", "n_regionkey").alias("src"), name("nation-", "n_nationkey").alias("dst"))
        .unionByName(t("customer").select(name("nation-", "c_nationkey").alias("src"), name("customer-", "c_custkey").alias("dst")))
        .unionByName(t("supplier").select(name("nation-", "s_nationkey").alias("src"), name("supplier-", "s_suppkey").alias("dst")))
    )
    return edges, t("region").where("r_regionkey < 3").select(name("region-", "r_regionkey").alias("node"))


def deps_why(spark, sf_dir):
    edges, roots = _tree(spark, sf_dir)
    return D.why(spark, edges, roots).select("node", "depth", F.array_join("chain", ">").alias("chain"))


def deps_why_recursive(spark, sf_dir):
    edges, roots = _tree(spark, sf_dir)
    edges.createOrReplaceTempView("sievework_edges")
    roots.createOrReplaceTempView("sievework_roots")
    return spark.sql(D.why_sql("sievework_edges", "sievework_roots"))


def deps_direct(spark, sf_dir):
    edges, roots = _tree(spark, sf_dir)
    return D.direct(edges, roots)


def deps_orphans(spark, sf_dir):
    edges, roots = _tree(spark, sf_dir)
    nodes = edges.select(F.col("dst").alias("node")).unionByName(edges.select(F.col("src").alias("node"))).distinct()
    return D.orphans(nodes, D.why(spark, edges, roots).select("node"))


def registry_policy(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_brand").alias("name"), F.lit("1.0.0").alias("version"), F.lit("registry").alias("source_kind"), (F.col("p_size") % 2 == 0).alias("registry_recorded"),
        F.when(F.col("p_size") % 3 == 0, "https://mirror.invalid/").when(F.col("p_size") % 3 == 1, "https://own.invalid").alias("source_url"),
    )
    return D.registry_policy(rows, [("brand#1*", "https://own.invalid/"), ("Brand*", "https://mirror.invalid")], ["BRAND#2*", "@own"], "https://public.invalid").groupBy("rule").agg(F.count("*").alias("n"))


def source_policy(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "customer").select(
        c("c_name").alias("name"), F.when(c("c_custkey") % 4 == 0, "git").when(c("c_custkey") % 4 == 1, "url").when(c("c_custkey") % 4 == 2, "path").otherwise("registry").alias("source_kind"),
        F.when(c("c_custkey") % 8 == 0, F.sha1("c_name")).when(c("c_custkey") % 12 == 0, "main").alias("source_rev"),
    )
    return D.source_policy(rows).groupBy("rule").agg(F.count("*").alias("n"))


def missing_integrity(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 10).alias("lockfile"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("version"), F.lit("registry").alias("source_kind"),
        F.when(F.col("p_size") % 2 == 0, "x").alias("integrity"), (F.col("p_size") == 1).alias("member"),
    )
    return D.missing_integrity(rows).select("lockfile", "missing", F.array_join("samples", ",").alias("samples"))


def name_guard(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "part").select(
        c("p_name").alias("name"), (c("p_partkey") % 10 == 0).alias("in_lockfile"), (c("p_partkey") % 7 != 0).alias("found"), F.when(c("p_size") % 5 != 0, c("p_size") * 4).alias("age_days"),
        F.when(c("p_partkey") % 3 != 0, F.floor(c("p_retailprice"))).alias("downloads"), (c("p_size") > 25).alias("has_repository"),
    )
    return D.name_guard(rows).groupBy("suspicion").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


POPULAR = ["thing", "that", "there", "would", "their", "other", "about"]


def typosquat(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("name")).where("name <> ''").distinct()
    return D.typosquats(words, POPULAR).select("name", "near")


def bom_components(spark, sf_dir):
    """Parts depend on the parts of their supplier's next line."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("part "), (F.col("l_partkey") % 40).cast("string"))
    packages = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("node"), D.purl(F.lit("npm"), name, F.lit("1.0.0+b")).alias("purl"))
    edges = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("src"), F.concat_ws(":", "l_orderkey", (F.col("l_linenumber") + 1).cast("string")).alias("dst"))
    return D.components(packages, edges).select("purl", F.array_join("depends_on", ",").alias("depends_on"))


def unplanned(spark, sf_dir):
    c = F.col
    planned = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(c("p_brand").alias("name"), c("p_size").cast("string").alias("version"), F.when(c("p_partkey") % 50 == 1, "git").otherwise("registry").alias("source_kind"))
    installed = table(spark, sf_dir, "part").select(c("p_brand").alias("name"), c("p_size").cast("string").alias("version"), "p_partkey")
    return D.unplanned(installed, planned).select("name", "version", "p_partkey")


def cooldown_exemption(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "orders").select(
        F.when(c("o_orderkey") % 3 == 0, "Upgraded").otherwise("Added").alias("kind"), F.array(c("o_orderpriority"), c("o_orderstatus")).alias("old_ids"), F.array(F.lit("1-URGENT"), F.lit("F")).alias("new_ids")
    )
    return D.cooldown_exempt(rows).groupBy("kind", "level").agg(F.count("*").alias("n"))


DECLARED = ["MIT/Apache-2.0", "BSD 3-Clause", "GPL-3.0-or-later OR MIT", "(MIT AND GPL-2.0-only)", "new bsd license", "see LICENSE file!", "Apache License, Version 2.0", "LGPL-2.1 WITH exception", ""]


def license_verdict(spark, sf_dir):
    """Parts declare licences in turn; copyleft is denied."""
    ship(spark)
    raw = F.element_at(F.array(*map(F.lit, DECLARED)), (F.col("p_partkey") % len(DECLARED) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(L.normalize(raw).alias("license"))
    return rows.withColumn("v", L.verdict(F.col("license"), ["GPL-3.0", "GPL-2.0", "LGPL-2.1"], [])).groupBy("license", F.col("v.verdict").alias("verdict"), F.array_join("v.ids", ",").alias("ids")).agg(F.count("*").alias("n"))


def requirement_allows(spark, sf_dir):
    ship(spark)
    specs = ["^1.2.0", "~2.1", ">=1.0.0 <3.0.0", "1.x || 3.*", "1.0.0 - 2.0.0", "nonsense"]
    rows = _packages(spark, sf_dir).withColumn("requirement", F.element_at(F.array(*map(F.lit, specs)), (F.col("p_partkey") % len(specs) + 1).cast("int")))
    return rows.groupBy("requirement", V.requirement_allows(F.col("ecosystem"), F.col("requirement"), F.col("version")).alias("allowed")).agg(F.count("*").alias("n"))


def name_normal(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("__"), F.regexp_replace("c_name", "#", "._-"), F.lit(".")).alias("name"))
    return rows.select("name", V.normal_name(F.lit("PyPI"), F.col("name")).alias("normal"))


_PACKAGES = """
packages AS (
  SELECT p_brand AS name, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_size || '.' || p_partkey % 7 || '.0-rc.1' WHEN p_partkey % 13 = 0 THEN 'latest' ELSE p_size || '.' || p_partkey % 7 || '.0' END AS version FROM part
),
keyed AS (
  SELECT *, CASE WHEN version <> 'latest' THEN [CAST(string_split(version, '.')[1] AS INT), CAST(string_split(version, '.')[2] AS INT), 0, CASE WHEN contains(version, '-') THEN 0 ELSE 1 END] END AS k FROM packages
),
judged AS (
  SELECT DISTINCT name, version, k, 'ADV-' || name AS id,
    CASE WHEN version IN ('1.0.0', '2.3.0') THEN true WHEN k IS NULL THEN NULL
         ELSE (k >= [10, 0, 0, 1] AND k < [20, 0, 0, 1]) OR (k >= [25, 1, 0, 1] AND k < [30, 0, 0, 1]) END AS hit
  FROM keyed WHERE CAST(right(name, 1) AS INT) % 2 = 0
)"""
_RELEASES = """
releases AS (
  SELECT o_custkey AS package, '1.' || o_orderkey || '.0' || CASE WHEN o_orderkey % 5 = 0 THEN '-beta' ELSE '' END AS version, o_orderkey AS n, o_orderkey % 5 = 0 AS pre,
    o_orderpriority AS publisher, o_orderdate AS published, o_totalprice > 200000 AS install_script,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS provenance, CASE WHEN o_orderkey % 97 = 0 THEN 'yanked' END AS withdrawn
  FROM orders
),
full_ AS (
  SELECT *, CASE WHEN pre THEN lag(version) OVER w ELSE last_value(CASE WHEN NOT pre THEN version END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS previous,
    list_sort(list_distinct(coalesce(list(publisher) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []))) AS earlier
  FROM releases WINDOW w AS (PARTITION BY package ORDER BY n)
)"""
_EDGES = """
edges AS (
  SELECT 'region-' || n_regionkey AS src, 'nation-' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation-' || c_nationkey, 'customer-' || c_custkey FROM customer
  UNION ALL SELECT 'nation-' || s_nationkey, 'supplier-' || s_suppkey FROM supplier
),
roots AS (SELECT 'region-' || r_regionkey AS node FROM region WHERE r_regionkey < 3),
reach AS (
  SELECT node, 0 AS depth, node AS chain FROM roots
  UNION ALL SELECT e.dst, r.depth + 1, r.chain || '>' || e.dst FROM reach r JOIN edges e ON e.src = r.node
)"""

QUERIES = {f.__name__: f for f in (
    advisory_match, advisory_checks, advisory_fixed_in, advisory_safe_targets, advisory_ignored, advisory_aliases, version_order, release_previous, release_publishers, release_signals, deps_diff,
    deps_why, deps_why_recursive, deps_direct, deps_orphans, registry_policy, source_policy, missing_integrity, name_guard, typosquat, bom_components, unplanned, cooldown_exemption, license_verdict,
    requirement_allows, name_normal,
)}
ORACLES = {
    "requirement_allows": """WITH p AS (
  SELECT p_partkey AS k, p_size AS a, p_partkey % 7 AS b, ['^1.2.0', '~2.1', '>=1.0.0 <3.0.0', '1.x || 3.*', '1.0.0 - 2.0.0', 'nonsense'][CAST(p_partkey % 6 AS INT) + 1] AS requirement FROM part
)
SELECT requirement, CASE WHEN k % 6 = 5 OR (k % 11 <> 0 AND k % 13 = 0) THEN NULL WHEN k % 11 = 0 THEN false
  ELSE CASE k % 6 WHEN 0 THEN a = 1 AND b >= 2 WHEN 1 THEN a = 2 AND b = 1 WHEN 2 THEN a IN (1, 2) WHEN 3 THEN a IN (1, 3) ELSE a = 1 OR (a = 2 AND b = 0) END END AS allowed, count(*) AS n
FROM p GROUP BY ALL""",
    "advisory_match": f"WITH {_PACKAGES} SELECT name, version, id, hit FROM judged",
    "advisory_checks": f"WITH {_PACKAGES} SELECT name, version, count(*) AS undecided, 'incomplete' AS status FROM judged WHERE hit IS NULL GROUP BY ALL",
    "advisory_fixed_in": f"WITH {_PACKAGES} SELECT name, version, CASE WHEN k < [20, 0, 0, 1] THEN '20.0.0' WHEN k < [30, 0, 0, 1] THEN '30.0.0' END AS fixed_in FROM judged WHERE hit",
    "advisory_safe_targets": f"WITH {_PACKAGES} SELECT DISTINCT name AS package_key, version AS current, t AS version FROM judged, unnest(['20.0.0', '30.0.0']) AS x(t) WHERE hit AND k < CASE t WHEN '20.0.0' THEN [20, 0, 0, 1] ELSE [30, 0, 0, 1] END",
    "advisory_ignored": f"""WITH {_PACKAGES}, ids AS (SELECT DISTINCT 'ADV-' || p_brand AS id FROM part WHERE p_size < 3)
SELECT 'open' AS kind, count(*) AS n FROM judged WHERE hit AND id NOT IN (SELECT id FROM ids) UNION ALL SELECT 'ignored', count(*) FROM judged WHERE hit AND id IN (SELECT id FROM ids)""",
    "advisory_aliases": """WITH g AS (
  SELECT p_brand AS package, p_size, list_sort(list(format('A-{:05d}', p_partkey))) AS ids, max(CASE WHEN p_partkey % 3 = 0 THEN 'high' END) AS severity, max(CASE WHEN p_partkey % 2 = 0 THEN '2.0.0' END) AS fixed_in
  FROM part GROUP BY p_brand, p_size
) SELECT package, ids[1] AS id, severity, fixed_in, array_to_string(list_sort(list_concat(ids[2:], ['C-' || p_size])), ',') AS aliases FROM g""",
    "version_order": f"WITH {_PACKAGES} SELECT name, arg_max(version, k) AS highest, arg_min(version, k) AS lowest FROM keyed GROUP BY name",
    "release_previous": f"WITH {_RELEASES} SELECT package, version, previous FROM full_",
    "release_publishers": f"WITH {_RELEASES} SELECT package, version, array_to_string(earlier, ',') AS earlier FROM full_",
    "release_signals": f"""WITH {_RELEASES},
j AS (SELECT a.*, b.install_script AS pi, b.provenance AS pp FROM full_ a LEFT JOIN full_ b ON a.package = b.package AND a.previous = b.version)
SELECT rule, count(*) AS n FROM (
  SELECT 'RELEASE/YoungRelease' AS rule FROM j WHERE floor((epoch(TIMESTAMP '1998-08-01') - epoch(published)) / 3600) < 24
  UNION ALL SELECT 'RELEASE/NewInstallScript' FROM j WHERE install_script AND NOT pi
  UNION ALL SELECT 'RELEASE/ProvenanceRegression' FROM j WHERE pp AND NOT provenance
  UNION ALL SELECT 'RELEASE/PublisherChange' FROM j WHERE NOT coalesce(provenance, false) AND len(earlier) > 0 AND NOT list_contains(earlier, publisher)
  UNION ALL SELECT 'RELEASE/Withdrawn' FROM j WHERE withdrawn IS NOT NULL
) GROUP BY rule""",
    "deps_diff": """WITH rows AS (
  SELECT l_suppkey AS lockfile, l_partkey % 50 AS name, l_linenumber || '.' || l_orderkey % 5 || '.0' AS version, [l_linenumber, l_orderkey % 5] AS k, l_shipdate < TIMESTAMP '1995-06-01' AS old FROM lineitem
),
o AS (SELECT DISTINCT lockfile, name, version, k FROM rows WHERE old),
n AS (SELECT DISTINCT lockfile, name, version, k FROM rows WHERE NOT old),
a AS (SELECT *, row_number() OVER (PARTITION BY lockfile, name ORDER BY k) AS r FROM o ANTI JOIN n USING (lockfile, name, version)),
b AS (SELECT *, row_number() OVER (PARTITION BY lockfile, name ORDER BY k) AS r FROM n ANTI JOIN o USING (lockfile, name, version)),
c AS (
  SELECT coalesce(a.lockfile, b.lockfile) AS lockfile, coalesce(a.name, b.name) AS name, b.version AS to_version,
    CASE WHEN a.k IS NULL THEN 'Added' WHEN b.k IS NULL THEN 'Removed' WHEN b.k >= a.k THEN 'Upgraded' ELSE 'Downgraded' END AS kind
  FROM a FULL JOIN b ON a.lockfile = b.lockfile AND a.name = b.name AND a.r = b.r
)
SELECT lockfile, name, kind, count(*) AS changes, min(to_version) AS least FROM c GROUP BY ALL""",
    "deps_why": f"WITH RECURSIVE {_EDGES} SELECT node, min(depth) AS depth, arg_min(chain, depth) AS chain FROM reach GROUP BY node",
    "deps_why_recursive": f"WITH RECURSIVE {_EDGES} SELECT node, min(depth) AS depth FROM reach GROUP BY node",
    "deps_direct": f"WITH RECURSIVE {_EDGES} SELECT DISTINCT dst AS node FROM edges JOIN roots ON src = node",
    "deps_orphans": f"WITH RECURSIVE {_EDGES} SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT node FROM reach)",
    "registry_policy": """WITH p AS (
  SELECT p_brand AS name, p_size % 2 = 0 AS recorded, CASE WHEN p_size % 3 = 0 THEN 'https://mirror.invalid' WHEN p_size % 3 = 1 THEN 'https://own.invalid' END AS url FROM part
),
q AS (SELECT *, starts_with(lower(name), 'brand#1') AS r1, starts_with(lower(name), 'brand') AS r2, starts_with(lower(name), 'brand#2') AS own, coalesce(url, 'https://public.invalid') AS u FROM p),
x AS (SELECT *, (own OR r1 OR r2) AND NOT recorded AND url IS NULL AS unbound FROM q)
SELECT rule, count(*) AS n FROM (
  SELECT 'unbound' AS rule FROM x WHERE unbound
  UNION ALL SELECT 'REGISTRY/Mismatch' FROM x WHERE NOT unbound AND ((r1 AND u <> 'https://own.invalid') OR (r2 AND u <> 'https://mirror.invalid'))
  UNION ALL SELECT 'REGISTRY/DependencyConfusion' FROM x WHERE NOT unbound AND own AND url IS NULL
) GROUP BY rule""",
    "source_policy": """SELECT CASE c_custkey % 4 WHEN 0 THEN 'SOURCE/UnpinnedGit' WHEN 1 THEN 'SOURCE/Url' ELSE 'SOURCE/Path' END AS rule, count(*) AS n
FROM customer WHERE c_custkey % 4 IN (1, 2) OR (c_custkey % 4 = 0 AND c_custkey % 8 <> 0) GROUP BY 1""",
    "missing_integrity": """WITH r AS (
  SELECT p_partkey % 10 AS lockfile, p_name AS name, CAST(p_partkey AS VARCHAR) AS version, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_name, CAST(p_partkey AS VARCHAR)) AS nth
  FROM part WHERE p_size % 2 = 1 AND p_size <> 1
)
SELECT lockfile, count(*) AS missing, array_to_string(list_sort(list_distinct(list(name || '@' || version) FILTER (WHERE nth <= 5))), ',') AS samples FROM r GROUP BY lockfile""",
    "name_guard": """WITH p AS (
  SELECT p_partkey % 10 = 0 AS l, p_partkey % 7 <> 0 AS f, CASE WHEN p_size % 5 <> 0 THEN p_size * 4 END AS a, CASE WHEN p_partkey % 3 <> 0 THEN floor(p_retailprice) END AS d, p_size > 25 AS r FROM part
),
q AS (SELECT *, CASE WHEN a < 90 THEN 2 ELSE 0 END + CASE WHEN d < 1000 THEN 1 ELSE 0 END + CASE WHEN r THEN 0 ELSE 1 END AS points FROM p)
SELECT CASE WHEN l THEN 'low' WHEN NOT f THEN 'high' WHEN points = 0 AND a IS NOT NULL AND d IS NOT NULL THEN 'low' WHEN points <= 2 THEN 'medium' ELSE 'high' END AS suspicion, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM q GROUP BY 1""",
    "typosquat": f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS name FROM documents),
p AS (SELECT * FROM (SELECT unnest({POPULAR}) AS q, unnest(range({len(POPULAR)})) AS o))
SELECT name, arg_min(q, o) AS near FROM w, p WHERE name <> '' AND (name = q OR (length(name) >= 5 AND length(q) >= 5 AND levenshtein(name, q) <= 2))
GROUP BY name HAVING NOT arg_min(q, o) = name""",
    "bom_components": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, 'pkg:npm/part%20' || l_partkey % 40 || '@1.0.0%2Bb' AS purl FROM lineitem),
d AS (SELECT a.purl, list_sort(list_distinct(list(b.purl))) AS t FROM l a JOIN l b ON a.o = b.o AND b.n = a.n + 1 GROUP BY a.purl)
SELECT DISTINCT l.purl, coalesce(array_to_string(d.t, ','), '') AS depends_on FROM l LEFT JOIN d USING (purl)""",
    "unplanned": """WITH p AS (SELECT p_brand AS name, p_size AS v, p_partkey % 50 = 1 AS git FROM part WHERE p_partkey % 3 <> 0)
SELECT p_brand AS name, CAST(p_size AS VARCHAR) AS version, p_partkey FROM part
WHERE p_brand NOT IN (SELECT name FROM p WHERE git) AND (p_brand, p_size) NOT IN (SELECT (name, v) FROM p)""",
    "cooldown_exemption": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Upgraded' ELSE 'Added' END AS kind,
  CASE WHEN o_orderkey % 3 = 0 AND (o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'F') THEN 'warn' ELSE 'fail' END AS level, count(*) AS n FROM orders GROUP BY ALL""",
    "license_verdict": """SELECT license, verdict, ids, count(*) AS n FROM part JOIN (VALUES
  (0, 'MIT OR Apache-2.0', 'allowed', ''), (1, 'BSD-3-Clause', 'allowed', ''), (2, 'GPL-3.0-or-later OR MIT', 'allowed', ''), (3, '(MIT AND GPL-2.0-only)', 'denied', 'GPL-2.0-only'), (4, 'BSD-3-Clause', 'allowed', ''),
  (5, NULL, 'unknown', ''), (6, 'Apache-2.0', 'allowed', ''), (7, 'LGPL-2.1 WITH exception', 'denied', 'LGPL-2.1'), (8, NULL, 'unknown', '')) AS t(m, license, verdict, ids) ON p_partkey % 9 = m GROUP BY ALL""",
    "name_normal": "SELECT '__' || replace(c_name, '#', '._-') || '.' AS name, lower(regexp_replace(replace(c_name, '#', '._-'), '[-_.]+', '-', 'g')) AS normal FROM customer",
}
