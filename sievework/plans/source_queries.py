"""Parsers and static rules, over files that are written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import static as A
from ..sources import coverage as C
from ..sources import lockfiles as K
from ..sources import manifests as Y
from ..sources import patches as P
from ..sources import registry as R
from .scan_queries import table

def _joined(order: str, *parts):
    """One text of the rows' parts in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(*parts).alias("t")))), lambda x: x["t"]), "\n")


def _lcov(spark, sf_dir):
    """One report a supplier, one record a part, one line entry a line item."""
    li = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    parts = li.groupBy("l_suppkey", "l_partkey").agg(
        F.concat(F.lit("SF:src/p"), F.first(s("l_partkey")), F.lit(".py\n"), _joined("l_orderkey", F.lit("DA:"), s("l_orderkey"), F.lit(","), F.floor("l_quantity").cast("string")), F.lit("\nLH:"),
                 F.count_if(F.col("l_quantity") > 25).cast("string"), F.lit("\nLF:"), F.count("*").cast("string"), F.lit("\nend_of_record")).alias("t")
    )
    return parts.groupBy(F.col("l_suppkey").alias("report")).agg(_joined("l_partkey", F.col("t")).alias("text"))


def lcov_totals(spark, sf_dir):
    return C.lcov_totals(_lcov(spark, sf_dir))


def lcov_lines(spark, sf_dir):
    return C.lcov_lines(_lcov(spark, sf_dir)).groupBy("report").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 25).alias("covered"))


def cobertura_totals(spark, sf_dir):
    """One report a nation, one class a customer, one line an order."""
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.concat(F.lit('<line number="'), F.col("o_orderkey").cast("string"), F.lit('" hits="'), (F.col("o_orderkey") % 3).cast("string"), F.lit('"/>'))
    classes = t.groupBy("c_nationkey", "c_custkey").agg(F.concat(F.lit('<class filename="c'), F.first(F.col("c_custkey").cast("string")), F.lit('.py"><lines>'), _joined("o_orderkey", line), F.lit("</lines></class>")).alias("x"))
    reports = classes.groupBy(F.col("c_nationkey").alias("report")).agg(F.concat(F.lit("<?xml version='1.0'?><coverage><packages><package><classes>"), _joined("c_custkey", F.col("x")), F.lit("</classes></package></packages></coverage>")).alias("text"))
    return C.cobertura_totals(reports)


def _patches(spark, sf_dir):
    """One patch an order, one file a line: two hunks, an added line with plus signs, a removed one. Texts are made from the keys once these are together."""
    def body(x):
        n = x["n"].cast("string")
        return F.concat(
            F.lit("diff --git a/f"), n, F.lit(".py b/f"), n, F.lit(".py\n--- a/f"), n, F.lit(".py\n+++ b/f"), n, F.lit(".py\n@@ -1,2 +"), x["p"],
            F.lit(",3 @@ head\n-old\n+++ counted\n keep\n+if x and y: pass\n@@ -9 +90 @@\n-gone\n+last"),
        )

    items = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("p"))))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("patch")).agg(items.alias("i")).select("patch", F.array_join(F.transform("i", body), "\n").alias("text"))


def patch_lines(spark, sf_dir):
    return P.diff_lines(_patches(spark, sf_dir)).where("kind = '+'").select("patch", "path", "line", "content")


def patch_files(spark, sf_dir):
    return P.changed_files(P.diff_lines(_patches(spark, sf_dir)))


def patch_complexity(spark, sf_dir):
    added = P.diff_lines(_patches(spark, sf_dir)).where("kind = '+'")
    return A.complexity_nodes(added)


def name_status(spark, sf_dir):
    raw = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 5).alias("k")).agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("M\0p"), "p_partkey")).otherwise(F.concat(F.lit("R100\0old"), "p_partkey", F.lit("\0p"), "p_partkey")))), "\0").alias("raw")
    )
    return P.name_status(raw).groupBy("status").agg(F.count("*").alias("n"), F.count("old").alias("renamed"))


def lockfile_packages(spark, sf_dir):
    """One lockfile of each of three formats a brand, in parts, as a brand's packages are too many to be put together in one task."""
    part = table(spark, sf_dir, "part")

    def texts(x):
        v, name, even = F.concat(F.lit("1."), x["s"].cast("string"), F.lit(".0")), F.concat(F.lit("p"), x["k"].cast("string")), x["s"] % 2 == 0
        npm = F.concat(F.lit(',"node_modules/'), name, F.lit('": {"version": "'), v, F.lit('", "resolved": "https://registry.invalid/p/-/p.tgz"'), F.when(even, ', "integrity": "sha512-x"').otherwise(""), F.lit("}"))
        cargo = F.concat(F.lit('[[package]]\nname = "'), name, F.lit('"\nversion = "'), v, F.lit('"\nsource = "registry+https://index.invalid"\n'), F.when(even, 'checksum = "ab"\n').otherwise(""), F.lit("\n"))
        return npm, cargo, F.concat(name, F.lit("=="), v, F.when(even, " \\\n    --hash=sha256:ab").otherwise(""), F.lit("\n"))

    names = ("package-lock.json", "Cargo.lock", "requirements.txt")
    items = F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")))
    grouped = part.where("p_partkey is not null and p_size is not null").groupBy("p_brand", F.pmod("p_partkey", F.lit(64)).cast("int").alias("n")).agg(items.alias("items"))
    joined = lambda k: F.array_join(F.transform("items", lambda x: texts(x)[k]), "")
    made = F.array(*(F.struct(F.lit(f).alias("f"), joined(k).alias("t")) for k, f in enumerate(names)))
    ends = F.array(F.struct(F.lit(-1).alias("n"), F.lit('{"lockfileVersion": 3, "packages": {"": {"name": "root"}').alias("t")), F.struct(F.lit(64).alias("n"), F.lit("}}").alias("t")))
    files = grouped.select("p_brand", "n", F.inline(made)).unionByName(part.select("p_brand").distinct().select("p_brand", F.lit(names[0]).alias("f"), F.inline(ends)))
    found = K.packages(files.select(F.concat_ws("/", "p_brand", "f").alias("path"), "n", F.col("t").alias("text")), "n")
    return found.groupBy("format", "ecosystem", "source_kind", "member").agg(F.count("*").alias("packages"), F.count("integrity").alias("hashed"), F.count("error").alias("errors"))


def osv_entries(spark, sf_dir):
    json = F.format_string(
        '{"id":"A-%d","summary":"s","aliases":["C-%d"],"database_specific":{"severity":"HIGH"},"references":[{"type":"WEB","url":"w"},{"type":"ADVISORY","url":"a"}],'
        '"affected":[{"package":{"ecosystem":"PyPI","name":"%s"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"%d.0.0"}]}]}]%s}',
        F.col("p_partkey"), F.col("p_size"), F.regexp_replace("p_brand", "#", "._"), F.col("p_size"), F.when(F.col("p_partkey") % 10 == 0, ',"withdrawn":"2024-01-01"').otherwise(""),
    )
    rows = R.osv_entries(table(spark, sf_dir, "part").select(json.alias("json")))
    return rows.select("id", "package_key", "severity", "reference", F.col("ranges")[0]["events"][1]["version"].alias("fixed"))


def npm_history(spark, sf_dir):
    """One packument a customer, one version an order."""
    ver = F.concat(F.lit("1."), F.col("o_orderkey").cast("string"), F.lit(".0"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), ver.alias("v"), "o_orderkey", "o_orderdate", "o_orderstatus")
    body = F.concat(F.lit('"'), F.col("v"), F.lit('":{"scripts":{'), F.when(F.col("o_orderkey") % 4 == 0, '"postinstall":"x"').otherwise('"test":"x"'), F.lit('},"_npmUser":{"name":"'), "o_orderstatus", F.lit('"}'), F.when(F.col("o_orderkey") % 6 == 0, ',"deprecated":"old"').otherwise(""), F.lit("}"))
    time = F.concat(F.lit('"'), F.col("v"), F.lit('":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    doc = rows.groupBy("package").agg(F.concat(F.lit('{"time":{'), F.array_join(F.collect_list(time), ","), F.lit('},"versions":{'), F.array_join(F.collect_list(body), ","), F.lit("}}")).alias("json"))
    found = R.npm_releases(doc)
    return found.groupBy("package").agg(F.count("*").alias("versions"), F.count_if("install_script").alias("scripts"), F.count("withdrawn").alias("withdrawn"), F.max("published").alias("newest"), F.countDistinct("publisher").alias("publishers"))


def _orders_by_customer(spark, sf_dir, item, wrap):
    """A JSON document a customer around an item an order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), item.alias("item"))
    return rows.groupBy("package").agg(F.concat(F.lit(wrap[0]), F.array_join(F.collect_list("item"), ","), F.lit(wrap[1])).alias("json"))


def pypi_history(spark, sf_dir):
    """A version an order with one to three files; a third of the versions has no wheel, a fifth no file, a seventh is yanked."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    file = lambda kind, hour: F.concat(F.lit(f'{{"packagetype":"{kind}","upload_time_iso_8601":"'), day, F.lit(f'T{hour}:00:00Z"'), F.when(k % 7 == 0, F.concat(F.lit(',"yanked":true,"yanked_reason":'), F.when(k % 2 == 0, '""').otherwise('"broken"'))).otherwise(""), F.lit("}"))
    files = F.when(k % 5 == 0, "").when(k % 3 == 0, file("sdist", "07")).otherwise(F.concat_ws(",", file("sdist", "09"), file("bdist_wheel", "08"), file("bdist_wheel", "10")))
    item = F.concat(F.lit('"1.'), k.cast("string"), F.lit('":['), files, F.lit("]"))
    docs = _orders_by_customer(spark, sf_dir, item, ('"releases":{', "}"))
    expression = F.when(F.col("package") % 4 == 0, '"license_expression":" MIT ",').when(F.col("package") % 4 == 1, '"classifiers":["License :: OSI Approved :: MIT License","Topic :: X","License :: Other"],').otherwise("")
    info = F.concat(F.lit('{"info":{'), expression, F.lit('"license":'), F.when(F.col("package") % 4 == 2, '" BSD "').otherwise('"a\\nb"'), F.lit("},"))
    found = R.pypi_releases(docs.select("package", F.concat(info, "json", F.lit("}")).alias("json")))
    return found.groupBy("package", "license").agg(F.count("*").alias("versions"), F.count_if("install_script").alias("scripts"), F.count_if(F.col("withdrawn") == "yanked").alias("yanked"), F.count_if(F.col("withdrawn") == "broken").alias("broken"), F.max("published").alias("newest"))


def crates_history(spark, sf_dir):
    k = F.col("o_orderkey")
    item = F.concat(
        F.lit('{"num":"1.'), k.cast("string"), F.lit('.0","created_at":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T01:02:03.5Z","yanked":'), F.when(k % 6 == 0, "true").otherwise("false"),
        F.when(k % 12 == 0, ',"yank_message":""').when(k % 12 == 6, ',"yank_message":"bad"').otherwise(""), F.when(k % 4 == 0, ',"trustpub_data":{"provider":"x"}').when(k % 4 == 1, ',"trustpub_data":null').otherwise(""),
        F.when(k % 3 > 0, F.concat(F.lit(',"published_by":{"login":"'), "o_orderstatus", F.lit('"}'))).otherwise(""), F.lit(',"license":"MIT"}'),
    )
    found = R.crate_releases(_orders_by_customer(spark, sf_dir, item, ('{"versions":[', "]}")))
    return found.groupBy("package").agg(
        F.count("*").alias("versions"), F.count("install_script").alias("scripts"), F.count_if("provenance").alias("proven"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("withdrawn") == "yanked").alias("yanked"), F.count_if(F.col("withdrawn") == "bad").alias("bad"), F.max("published").alias("newest"),
    )


def manifest_documents(spark, sf_dir):
    """One YAML file a nation, one document a customer; some are templates, some broken."""
    text = F.concat(
        F.lit("kind: Deployment\nmetadata:\n  name: "), F.lower(F.regexp_replace("c_name", "#", "-")), F.lit("\nspec:\n  replicas: "), (F.col("c_custkey") % 4).cast("string"),
        F.when(F.col("c_custkey") % 5 == 0, "\n  image: {{ .Values.image }\n bad").when(F.col("c_custkey") % 7 == 0, "\n bad").otherwise("\n  tags: [a, b]"),
    )
    files = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", text.alias("t")))), lambda x: x["t"]), "\n---\n").alias("text"))
    docs = Y.documents(files)
    return docs.groupBy("state").agg(F.count("*").alias("n"), F.sum(F.get_json_object("json", "$.spec.replicas").cast("long")).alias("replicas"))


def workflow_checkouts(spark, sf_dir):
    text = F.concat(
        F.lit("on:\n  "), F.when(F.col("s_suppkey") % 2 == 0, "pull_request_target:").otherwise("push:"), F.lit("\n    branches: [main]\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github."),
        F.when(F.col("s_suppkey") % 3 == 0, "event.pull_request.head.sha").otherwise("sha"), F.lit(" }}\n      - run: make\n"),
    )
    docs = Y.documents(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text")))
    return Y.privileged_checkouts(docs.where("state = 'ok'")).select("path", "job")


def _code(spark, sf_dir):
    """Source files of four languages from parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("import pickle\n# eval(1)\nx = 'eval(2)'\ndef f(a):\n    return eval(a)\n"), F.when(F.col("p_size") > 25, "subprocess.run(x, shell=True)\n").otherwise("pickle.loads(x)\n")))
    text = text.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("// eval(x)\nconst q = req.query.name;\nel.innerHTML = "), F.when(F.col("p_size") > 25, "q").otherwise("'safe'"), F.lit(";\nre.exec(s);\ncp.exec(cmd);\nconst k = "), k, F.lit(";\n")))
    text = text.when(F.col("p_partkey") % 4 == 2, F.lit('package main\nimport "unsafe"\nfunc main() {\n  exec.Command("ls") // panic()\n  panic("x")\n}\n')).otherwise(F.lit("fn main() {\n  unsafe { f() }\n  a.unwrap(); b.expect(\"no unwrap() here\");\n  Command::new(\"ls\");\n}\n"))
    ending = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".go", ".rs"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(F.concat(F.lit("src/f"), k, ending).alias("path"), text.alias("text"))


def static_rules(spark, sf_dir):
    return A.scan(_code(spark, sf_dir)).groupBy("rule", "line").agg(F.count("*").alias("n"))


def static_literals(spark, sf_dir):
    return A.literal_lines(_code(spark, sf_dir)).groupBy("content").agg(F.count("*").alias("n"))


_LI = "SELECT * FROM lineitem"
QUERIES = {f.__name__: f for f in (
    lcov_totals, lcov_lines, cobertura_totals, patch_lines, patch_files, patch_complexity, name_status, lockfile_packages, osv_entries, npm_history, pypi_history, crates_history, manifest_documents, workflow_checkouts, static_rules, static_literals,
)}
ORACLES = {
    "lcov_totals": f"SELECT l_suppkey AS report, 'src/p' || l_partkey || '.py' AS path, count(*) FILTER (WHERE l_quantity > 25) AS hit, count(*) AS found FROM ({_LI}) GROUP BY ALL",
    "lcov_lines": f"WITH l AS (SELECT l_suppkey AS report, l_partkey, l_orderkey, max(CAST(floor(l_quantity) AS VARCHAR)) AS q FROM ({_LI}) GROUP BY ALL) SELECT report, count(*) AS lines, count(*) FILTER (WHERE CAST(q AS BIGINT) > 25) AS covered FROM l GROUP BY report",
    "cobertura_totals": "SELECT CAST(c_nationkey AS INT) AS report, 'c' || c_custkey || '.py' AS path, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS hit, count(*) AS found FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "patch_lines": """WITH l AS (SELECT l_orderkey AS patch, 'f' || l_linenumber || '.py' AS path, CAST(l_partkey AS BIGINT) AS s FROM lineitem)
SELECT patch, path, s AS line, '++ counted' AS content FROM l UNION ALL SELECT patch, path, s + 2, 'if x and y: pass' FROM l UNION ALL SELECT patch, path, 90, 'last' FROM l""",
    "patch_files": "SELECT l_orderkey AS patch, 'f' || l_linenumber || '.py' AS path, 3 * count(*) AS added, 2 * count(*) AS removed FROM lineitem GROUP BY ALL",
    "patch_complexity": "SELECT 'f' || l_linenumber || '.py' AS path, 2 * count(*) AS nodes FROM lineitem GROUP BY ALL",
    "name_status": "SELECT CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'R' END AS status, count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 1) AS renamed FROM part GROUP BY 1",
    "lockfile_packages": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 0) AS h, count(DISTINCT p_brand) AS b FROM part)
SELECT 'PackageLock' AS format, 'npm' AS ecosystem, 'registry' AS source_kind, false AS member, n AS packages, h AS hashed, 0 AS errors FROM n UNION ALL SELECT 'PackageLock', 'npm', 'registry', true, b, 0, 0 FROM n
UNION ALL SELECT 'CargoLock', 'crates.io', 'registry', false, n, h, 0 FROM n UNION ALL SELECT 'Requirements', 'PyPI', 'registry', false, n, h, 0 FROM n""",
    "osv_entries": "SELECT 'A-' || p_partkey AS id, lower(replace(p_brand, '#', '-')) AS package_key, 'HIGH' AS severity, 'a' AS reference, p_size || '.0.0' AS fixed FROM part WHERE p_partkey % 10 <> 0",
    "npm_history": """SELECT o_custkey AS package, count(*) AS versions, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS scripts, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS withdrawn,
  max(date_trunc('second', o_orderdate)) AS newest, count(DISTINCT o_orderstatus) AS publishers FROM orders GROUP BY 1""",
    "pypi_history": """SELECT o_custkey AS package, CASE o_custkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT License OR Other' WHEN 2 THEN 'BSD' END AS license, count(*) AS versions, count(*) FILTER (o_orderkey % 3 = 0) AS scripts,
  count(*) FILTER (o_orderkey % 14 = 0) AS yanked, count(*) FILTER (o_orderkey % 14 = 7) AS broken, max(CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END) AS newest FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1, 2""",
    "crates_history": """SELECT o_custkey AS package, count(*) AS versions, CAST(0 AS BIGINT) AS scripts, count(*) FILTER (o_orderkey % 4 = 0) AS proven, count(DISTINCT o_orderstatus) FILTER (o_orderkey % 3 > 0) AS publishers,
  count(*) FILTER (o_orderkey % 12 = 0) AS yanked, count(*) FILTER (o_orderkey % 12 = 6) AS bad, max(CAST(o_orderdate AS DATE)) + INTERVAL '1 hour 2 minutes 3.5 seconds' AS newest FROM orders GROUP BY 1""",
    "manifest_documents": "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'template' WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'ok' END AS state, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN c_custkey % 4 END) AS BIGINT) AS replicas FROM customer GROUP BY 1",
    "workflow_checkouts": "SELECT CAST(s_suppkey AS VARCHAR) AS path, 'build' AS job FROM supplier WHERE s_suppkey % 6 = 0",
    "static_rules": """WITH p AS (SELECT p_partkey % 4 AS k, p_size > 25 AS big FROM part)
SELECT rule, line, count(*) AS n FROM p JOIN (VALUES
  (0, NULL, 'SAST/PythonEval', 5), (0, true, 'SAST/PythonSubprocessShell', 6), (0, false, 'SAST/PythonPickle', 6), (1, true, 'SAST/InnerHTMLAssignment [tainted]', 3), (1, NULL, 'SAST/ChildProcessExec', 5),
  (2, NULL, 'SAST/GoUnsafe', 2), (2, NULL, 'SAST/GoExecCommand', 4), (2, NULL, 'SAST/GoPanic', 5), (3, NULL, 'SAST/RustUnsafeBlock', 2), (3, NULL, 'SAST/RustUnwrap', 3), (3, NULL, 'SAST/RustExpect', 3), (3, NULL, 'SAST/RustCommandNew', 4)
) AS r(k2, when_, rule, line) ON k = k2 AND (when_ IS NULL OR when_ = big) GROUP BY rule, line""",
    "static_literals": """WITH p AS (SELECT p_partkey % 4 AS k, p_size > 25 AS big FROM part)
SELECT content, count(*) AS n FROM p JOIN (VALUES (0, NULL, 'eval(2)'), (1, false, 'safe'), (2, NULL, 'unsafe'), (2, NULL, 'ls'), (2, NULL, 'x'), (3, NULL, 'no unwrap() here'), (3, NULL, 'ls')) AS r(k2, when_, content)
ON k = k2 AND (when_ IS NULL OR when_ = big) GROUP BY content""",
}
