"""Trees, snapshots, installed packages and plans, written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import report as R
from ..operators import scan as S
from ..sources import trees as T
from .scan_queries import _EXTRA, EXTRA, _findings, table

GLOBS = ["**/*_test.py", "tests/**", "src/?1/*.rs"]


def _paths(spark, sf_dir):
    """A path an order: tests, sources and workflows."""
    k = F.col("o_orderkey")
    path = (
        F.when(k % 5 == 0, F.concat(F.lit("a/b/m"), k.cast("string"), F.lit("_test.py")))
        .when(k % 5 == 1, F.concat(F.lit("tests/x/"), k.cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("src/"), (k % 100).cast("string"), F.lit("/"), k.cast("string"), F.lit(".rs")))
        .when(k % 5 == 3, F.concat(F.lit(".github/workflows/w"), k.cast("string"), F.when(k % 2 == 0, ".yml").otherwise(".txt")))
        .otherwise(F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")))
    )
    return table(spark, sf_dir, "orders").select(k.alias("k"), path.alias("path"), F.col("o_orderpriority").alias("text"))


def tree_matching(spark, sf_dir):
    return T.matching(_paths(spark, sf_dir), GLOBS).select("path")


def tree_workflows(spark, sf_dir):
    return T.workflows(_paths(spark, sf_dir)).select("path", "at")


def tree_changed(spark, sf_dir):
    p = _paths(spark, sf_dir)
    base = p.where("k % 7 <> 0").withColumn("text", F.when(F.col("k") % 3 == 0, "old").otherwise(F.col("text")))
    return T.changed(p.where("k % 11 <> 0"), base).select("path", "status")


def tree_installed(spark, sf_dir):
    k = F.col("p_partkey")
    inner = F.when(k % 3 == 0, "node_modules/a/").otherwise("")
    name = F.when(k % 2 == 0, F.concat(F.lit("@s/p"), k.cast("string"))).otherwise(F.concat(F.lit("p"), k.cast("string")))
    path = F.concat(F.lit("app/"), inner, F.lit("node_modules/"), name, F.when(k % 7 == 0, "/lib").otherwise(""), F.lit("/package.json"))
    text = F.when(k % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("p_size").cast("string").alias("version"), F.create_map(F.lit("install"), F.col("p_brand")).alias("scripts"), (k % 4 == 0).alias("gypfile"))))
    rows = T.installed(table(spark, sf_dir, "part").select(path.alias("path"), text.alias("text")))
    return rows.select("name", "version", F.element_at("scripts", "install").alias("script"), "native", "depth")


def pip_plan_items(spark, sf_dir):
    """One plan a supplier, of its lines."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    url = F.concat(F.lit("https://h/"), k.cast("string"), F.when(k % 3 == 0, "-py3.whl#x").otherwise(".tar.gz"))
    info = F.struct(
        url.alias("url"), F.when(k % 3 < 2, F.struct(F.when(k % 2 == 0, F.concat(F.lit("sha256="), F.md5(k.cast("string")))).alias("hash"))).alias("archive_info"), F.when(k % 3 == 2, F.struct(F.lit(False).alias("editable"))).alias("dir_info"),
    )
    item = F.struct(F.struct(F.concat(F.lit("My.Pkg_"), k.cast("string")).alias("name"), F.col("l_linenumber").cast("string").alias("version")).alias("metadata"), (k % 5 == 0).alias("requested"), info.alias("download_info"))
    files = li.groupBy(F.col("l_suppkey").alias("project")).agg(F.to_json(F.struct(F.collect_list(item).alias("install"))).alias("text"))
    return T.pip_plan(files).select("project", "name", "version", "kind", "sha256", "requested")


def lockfile_entry_lines(spark, sf_dir):
    """A lockfile a customer: each order gives three lines, and asks for what stands in its own ones and for what stands nowhere."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("k"))
    name, version = F.concat(F.lit("pkg-"), F.col("k").cast("string")), F.concat(F.lit("1."), (F.col("k") % 13).cast("string"), F.lit(".0"))
    parts = F.array(F.concat(F.lit('"'), name, F.lit('": {')), F.lit("  x"), F.concat(F.lit('  "version": "'), version, F.lit('"')))
    texts = o.groupBy("path").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", parts.alias("l")))), lambda x: x["l"])), "\n").alias("text"))
    asked = o.select("path", name.alias("name"), F.when(F.col("k") % 4 == 0, "9.9.9").otherwise(version).alias("version"))
    return T.entry_lines(lines(texts), asked)


def scan_of_base(spark, sf_dir):
    """Findings that the head has and the base hadn't, by rule and value, from the texts of two revisions."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    found = {}
    for rev, files in (("head", d.where("doc_id % 3 <> 0")), ("base", d.where("doc_id % 3 <> 1"))):
        found[rev] = S.scan(files.select("path", "text"), "path", extra=EXTRA, entropy=False).select("rule", "value")
    return found["head"].exceptAll(found["base"]).groupBy("rule", "value").agg(F.count("*").alias("n"))


def report_kinds(spark, sf_dir):
    """Active and suppressed findings, by whether an even line suppresses."""
    f = _findings(spark, sf_dir).withColumn("suppressed", F.when(F.col("line") % 2 == 0, "even"))
    active, gone = S.split(f)
    return active.agg(F.count("*").alias("n")).select(F.lit("active").alias("kind"), "n").unionByName(R.suppression_tally(gone.select(F.col("suppressed").alias("kind"))))


_PATHS = """WITH p AS (
  SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'a/b/m' || o_orderkey || '_test.py' WHEN 1 THEN 'tests/x/' || o_orderkey WHEN 2 THEN 'src/' || o_orderkey % 100 || '/' || o_orderkey || '.rs'
    WHEN 3 THEN '.github/workflows/w' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.yml' ELSE '.txt' END ELSE 'src/m' || o_orderkey || '.py' END AS path, o_orderpriority AS text FROM orders
)"""
QUERIES = {f.__name__: f for f in (tree_matching, tree_workflows, tree_changed, tree_installed, pip_plan_items, lockfile_entry_lines, scan_of_base, report_kinds)}
ORACLES = {
    "tree_matching": _PATHS + " SELECT path FROM p WHERE k % 5 IN (0, 1) OR (k % 5 = 2 AND k % 100 > 9 AND k % 10 = 1)",
    "tree_workflows": _PATHS + " SELECT path, CAST(row_number() OVER (ORDER BY path) AS INT) AS at FROM p WHERE k % 5 = 3 AND k % 2 = 0",
    "tree_changed": _PATHS + """,
h AS (SELECT path, text FROM p WHERE k % 11 <> 0), b AS (SELECT path, CASE WHEN k % 3 = 0 THEN 'old' ELSE text END AS text FROM p WHERE k % 7 <> 0)
SELECT coalesce(h.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM h FULL JOIN b ON h.path = b.path WHERE h.path IS NULL OR b.path IS NULL OR h.text <> b.text""",
    "tree_installed": """SELECT CASE WHEN p_partkey % 2 = 0 THEN '@s/p' ELSE 'p' END || p_partkey AS name, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS version, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS script,
  p_partkey % 5 <> 0 AND p_partkey % 4 = 0 AS native, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS depth FROM part WHERE p_partkey % 7 <> 0""",
    "pip_plan_items": """SELECT l_suppkey AS project, 'my-pkg-' || l_partkey AS name, CAST(l_linenumber AS VARCHAR) AS version, CASE l_partkey % 3 WHEN 0 THEN 'wheel' WHEN 1 THEN 'sdist' ELSE 'source' END AS kind,
  CASE WHEN l_partkey % 3 < 2 AND l_partkey % 2 = 0 THEN md5(CAST(l_partkey AS VARCHAR)) END AS sha256, l_partkey % 5 = 0 AS requested FROM lineitem""",
    "lockfile_entry_lines": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, CAST(3 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 2 AS INT) AS line FROM orders),
n AS (SELECT *, lead(k) OVER (PARTITION BY path ORDER BY k) AS next FROM o)
SELECT path, 'pkg-' || k AS name, CASE WHEN k % 4 = 0 THEN '9.9.9' ELSE '1.' || k % 13 || '.0' END AS version, CASE WHEN k % 4 <> 0 THEN line END AS line FROM n""",
    "scan_of_base": _EXTRA + """SELECT rule, value, count(*) AS n FROM (SELECT rule, value FROM findings WHERE doc_id % 3 <> 0 EXCEPT ALL SELECT rule, value FROM findings WHERE doc_id % 3 <> 1) GROUP BY ALL""",
    "report_kinds": _EXTRA + "SELECT CASE WHEN line % 2 = 0 THEN 'even' ELSE 'active' END AS kind, count(*) AS n FROM findings GROUP BY 1",
}
