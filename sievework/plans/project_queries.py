"""Ignore files, manifests' requirements, scans of source files, stored advisories and image layers, written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan as S
from ..sources import ignores as I  # noqa: E741
from ..sources import registry, requirements
from .scan_queries import table
from .tree_queries import _PATHS, _paths

IGNORE = [
    (".gitignore", "# built\n\n*.txt\n!w1*.txt\n/tests/x/1*\nsrc/?7/\n!*.rs\n"),
    ("src/.gitignore", "/m*4.py\n!m14.py\n"),
    ("a/.gitignore", "b/*\n!b/*0_test.py\n"),
    (".ignore", "!src/m24.py\nw*18.yml\n"),
]


def tree_walked(spark, sf_dir):
    files = _paths(spark, sf_dir).select("path", "text").unionByName(spark.createDataFrame(IGNORE, "path string, text string"))
    return I.walked(files).where(~F.col("path").rlike("ignore$")).select("path")


def manifest_requirements(spark, sf_dir):
    """A project a part, of four kinds in turn; each asks for what its manifest names and for what none does."""
    k, key, size = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("r/p"), key).alias("dir"))
    at = lambda rest: F.concat(F.col("dir"), F.lit(rest))
    npm = F.to_json(F.struct(F.create_map(F.lit("dep"), F.concat(F.lit("^"), size)).alias("devDependencies"), F.create_map(F.lit("dep"), F.lit("*"), F.lit("other"), F.lit("1")).alias("peerDependencies")))
    root = F.concat(F.lit('[workspace]\n[workspace.dependencies]\ndep = { version = "'), size, F.lit('" }\n'))
    member = F.concat(F.lit('[package]\nname = "m'), key, F.lit('"\n[dependencies]\n'), F.when(k % 8 == 1, "dep = { workspace = true }\n").otherwise('alias = { package = "dep", path = "x" }\n'))
    python = F.concat(
        F.lit("[project]\nname = 'x'\ndependencies = ["), F.when(k % 8 == 2, F.concat(F.lit("'Dep[more] (>="), size, F.lit(") ; python_version > \"3\"'"))).otherwise(""),
        F.lit("]\n[tool.poetry.group.dev.dependencies]\nDEP = { version = '~"), size, F.lit("' }\n"),
    )
    files = p.where(k % 4 == 0).select(at("/package.json").alias("path"), npm.alias("text"))
    for kind, path, text in ((1, "/Cargo.toml", root), (1, "/crates/m/Cargo.toml", member), (1, "/target/m/Cargo.toml", member), (2, "/app/pyproject.toml", python)):
        files = files.unionByName(p.where(k % 4 == kind).select(at(path).alias("path"), text.alias("text")))
    of = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % 4 + 1).cast("int"))
    asked = p.select("dir", of("npm", "crates.io", "PyPI", "Go").alias("ecosystem"), F.when(k % 4 == 1, F.concat(F.lit("m"), key)).otherwise("").alias("member"), of(".", "", "app", "").alias("at"), F.explode(F.array(F.lit("dep"), F.lit("none"))).alias("name"))
    return requirements.requirements(asked, requirements.declared(files)).select("dir", "name", "requirement", "syntax")


def scan_sources(spark, sf_dir):
    """Mail addresses in comments, literals and plain text; some are suppressed on their line or by the one below."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    mail = F.concat(F.lit("u"), key, F.lit("@corp.io"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("# a@corp.io\nx = '"), mail, F.lit("'\n")))
        .when(k % 4 == 1, F.concat(F.lit("// a@corp.io\n\nconst a = \""), mail, F.lit('"; // sievework: ignore - ours\n')))
        .when(k % 4 == 2, F.concat(F.lit("mail: "), mail))
        .otherwise(F.concat(F.lit("package x\nvar a = `"), mail, F.lit("`\n// sievework: ignore below\n")))
    )
    path = F.concat(F.lit("f"), key, F.element_at(F.array(*map(F.lit, (".py", ".ts", ".txt", ".go"))), (k % 4 + 1).cast("int")))
    return S.scan_project(table(spark, sf_dir, "part").select(path.alias("path"), text.alias("text")), entropy=False).select("path", "line", "rule", "severity", "value", "suppressed")


def advisory_shards(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(registry.shard_of(F.col("c_name")).alias("shard")).agg(F.count("*").alias("n"))


def image_layers(spark, sf_dir):
    """An image a customer, its orders the layers; every other image has a manifest, which names each layer twice, and some that aren't there or lie outside."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("blobs/sha256/"), key)).when(k % 3 == 1, F.concat(F.lit("l"), key, F.lit("/layer.tar"))).otherwise(F.concat(F.lit("../x"), key))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), k.alias("k"), path.alias("path"))
    twice = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: F.array(x["path"], x["path"])))
    manifest = o.where("image % 2 = 0").groupBy("image").agg(F.to_json(F.array(F.struct(twice.alias("Layers")))).alias("text"))
    entries = o.where("k % 5 <> 0").select("image", "path", F.lit(None).cast("string").alias("text"))
    return S.image_layers(entries.unionByName(manifest.select("image", F.lit("manifest.json").alias("path"), "text")))


_DIR = "'r/p' || p_partkey"
QUERIES = {f.__name__: f for f in (tree_walked, manifest_requirements, scan_sources, advisory_shards, image_layers)}
ORACLES = {
    "tree_walked": _PATHS + """ SELECT path FROM p WHERE NOT CASE k % 5 WHEN 0 THEN k % 10 = 5 WHEN 1 THEN starts_with(CAST(k AS VARCHAR), '1') WHEN 2 THEN k % 100 > 9 AND k % 10 = 7
  WHEN 3 THEN CASE WHEN k % 2 = 1 THEN NOT starts_with(CAST(k AS VARCHAR), '1') ELSE ends_with(CAST(k AS VARCHAR), '18') END ELSE k % 10 = 4 AND k NOT IN (14, 24) END""",
    "manifest_requirements": f"""WITH a AS (SELECT {_DIR} AS dir, p_partkey AS k, p_size, unnest(['dep', 'none']) AS name FROM part),
r AS (SELECT *, CASE WHEN k % 4 = 3 THEN '' WHEN name = 'none' THEN NULL WHEN k % 4 = 0 THEN '^' || p_size WHEN k % 8 = 1 THEN CAST(p_size AS VARCHAR) WHEN k % 8 = 5 THEN '*' WHEN k % 8 = 2 THEN '>=' || p_size ELSE '~' || p_size END AS requirement FROM a)
SELECT dir, name, requirement, CASE WHEN requirement IS NULL THEN NULL WHEN k % 8 = 6 THEN 'poetry' ELSE 'native' END AS syntax FROM r""",
    "scan_sources": """SELECT 'f' || p_partkey || ['.py', '.ts', '.txt', '.go'][CAST(p_partkey % 4 AS INT) + 1] AS path, CAST([2, 3, 1, 2][CAST(p_partkey % 4 AS INT) + 1] AS INT) AS line, 'Generic PII (Email)' AS rule, 'low' AS severity,
  'u' || p_partkey || '@corp.io' AS value, [NULL, 'ours', NULL, 'below'][CAST(p_partkey % 4 AS INT) + 1] AS suppressed FROM part""",
    "advisory_shards": "SELECT CAST(('0x' || substr(md5(c_name), 1, 2)) AS INT) AS shard, count(*) AS n FROM customer GROUP BY 1",
    "image_layers": """WITH o AS (SELECT o_custkey AS image, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'blobs/sha256/' || o_orderkey ELSE 'l' || o_orderkey || '/layer.tar' END AS layer FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 < 2)
SELECT image, layer, CAST(row_number() OVER (PARTITION BY image ORDER BY CASE WHEN image % 2 = 0 THEN k END, layer) AS INT) AS at FROM o WHERE image % 2 = 0 OR k % 3 = 1""",
}
