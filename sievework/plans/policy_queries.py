"""The whole suppression pass and its files, wider scans, and reports, over findings in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import settled
from ..operators import report as R
from ..operators import scan as S
from ..operators import suppress as U
from .scan_queries import _EXTRA, EXTRA, _findings, doc_lines, table

TODAY = "2024-07-01"
RULES = [
    {"id": "E1", "rule": "License Line", "path": "src/1*.txt", "reason": "ours", "owner": "legal", "expires": "2024-06-30"},
    {"id": "E2", "rule": "License Line", "path": "src/2*.txt", "reason": "text only", "owner": "legal", "expires": "2024-07-08"},
]


def _keyed(spark, sf_dir):
    """One finding a path, rule and match: the first of its lines. Paths are those of ids modulo 40, so that the two halves of the documents share some."""
    f = _findings(spark, sf_dir).withColumns({"match": F.md5("value"), "path": F.concat(F.lit("src/"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt")), "half": F.col("doc_id") % 3 == 0})
    one = f.groupBy("half", "rule", "path", "match").agg(F.min("line").cast("bigint").alias("line"))
    print_ = F.md5(F.concat_ws("|", "rule", "path", "match", (F.col("line") % 3).cast("string")))
    return one.withColumns({"occurrence": F.lit(0).cast("bigint"), "fingerprint": print_})


def suppression_known(spark, sf_dir):
    """What a third of the documents has, against the rest as a baseline."""
    f = settled(_keyed(spark, sf_dir))
    found, _ = U.known(f.where("half").drop("half"), f.where("not half").drop("half"))
    return found.select("path", "rule", "match", "how", "moved_from")


def suppression_pass(spark, sf_dir):
    f = settled(_keyed(spark, sf_dir))
    base, baseline = (f.where("not half").where(F.col("rule") == r).drop("half") for r in ("License Line", "IPv4 Address"))
    rows, _ = U.suppression_pass(f.where("half").drop("half"), RULES, F.lit(TODAY).cast("date"), base, baseline)
    return rows.select("path", "rule", "match", "verdict", "detail")


def suppression_unclaimed(spark, sf_dir):
    f = settled(_keyed(spark, sf_dir))
    _, free = U.known(f.where("half").drop("half"), f.where("not half").drop("half"))
    return free.select("rule", "path", "match")


def finding_subjects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "file").when(k % 5 == 1, "package").when(k % 5 == 2, "url").when(k % 5 == 3, "file").otherwise("project")
    rows = p.select(
        k.alias("id"), kind.alias("kind"), F.concat(F.lit("./src\\"), k.cast("string")).alias("path"), F.when(k % 5 == 0, F.col("p_size")).alias("line"), F.col("p_name").alias("value"),
        F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.lit("https://h/x").alias("url"),
    )
    return U.subject(rows).select("id", "subject.path", "subject.line", "subject.match")


def _baseline_files(spark, sf_dir):
    """A baseline file a supplier: an old list, a new object, or something else."""
    li = table(spark, sf_dir, "lineitem")
    e = F.struct(
        F.lit("scan").alias("tool"), F.md5(F.col("l_orderkey").cast("string")).alias("fingerprint"), F.lit("m").alias("match"), F.col("l_returnflag").alias("rule_id"), F.concat(F.lit("./a/"), F.col("l_partkey").cast("string")).alias("path"),
        F.col("l_orderkey").alias("line_hint"), F.col("l_linenumber").cast("bigint").alias("occurrence"), F.col("l_orderkey").alias("line"),
    )
    rows = li.groupBy("l_suppkey").agg(F.to_json(F.sort_array(F.collect_list(e))).alias("list"))
    new = F.concat(F.lit('{"version":2,"salt":"00","generator":"g","entries":'), F.col("list"), F.lit("}"))
    return rows.select(F.col("l_suppkey").alias("file"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("\n "), F.col("list"))).when(F.col("l_suppkey") % 3 == 1, new).otherwise('{"version":3}').alias("text"))


def baseline_read(spark, sf_dir):
    return U.read_baseline(_baseline_files(spark, sf_dir)).select("file", "version", "tool", "rule", F.col("entry_path").alias("path"), "line", "fingerprint")


def baseline_update(spark, sf_dir):
    f = _keyed(spark, sf_dir)
    old = f.where("not half").withColumn("tool", F.when(F.col("rule") == "License Line", "licences").otherwise("scan"))
    rows = U.updated_baseline(old, f.where("half"), "scan")
    return rows.groupBy("tool").agg(F.count("*").alias("entries"), F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last"))


def baseline_migration(spark, sf_dir):
    f = _keyed(spark, sf_dir)
    return U.migrated(f.where("line % 2 = 0").select("path", "rule", "line"), f.where("half"), "scan").select("tool", "fingerprint", "rule", "path", "line")


def exception_migration(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.concat(F.lit("cve-"), F.col("p_size").cast("string")).alias("ignored_id"))
    return U.exceptions_from_ignores(ids, [{"id": "X", "rule": "OSV/CVE-7"}, {"id": "CVE-9"}], "sec", "2025-01-31").select("id", "rule", "owner", F.col("expires").cast("string").alias("expires"))


def triage_answers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('Sure: {"verdict": "false_positive", "confidence": 0.'), (k % 10).cast("string"), F.lit(', "reason": "r"} ok'))).when(k % 4 == 1, '{"verdict": "real", "confidence": 7}').when(k % 4 == 2, '{"verdict": "?"}').otherwise("none")
    return U.triaged(p.select(k.alias("id")), p.select(k.alias("id"), text.alias("text")), 0.5).select("id", "verdict", F.round("confidence", 6).alias("confidence"), "suppressed")


def _added(spark, sf_dir):
    """Every document a commit's patch of one file; lines with a licence hold the marker."""
    return doc_lines(spark, sf_dir).select((F.col("doc_id") % 97).alias("commit"), F.col("doc_id").cast("string").alias("path"), "line", "content")


def scan_history(spark, sf_dir):
    return S.history(_added(spark, sf_dir), EXTRA, False, "Licensed under").select("commit", "path", "line", "rule", "value", "severity")


def _layers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    path = F.concat(F.lit("app/"), (F.col("doc_id") / 2).cast("bigint").cast("string"), F.when(F.col("doc_id") % 4 < 2, "/.env").otherwise("/x.txt"))
    return d.select(F.concat(F.lit("layer"), (F.col("doc_id") % 2).cast("string")).alias("layer"), path.alias("path"), "text")


def scan_image(spark, sf_dir):
    return S.image(_layers(spark, sf_dir), EXTRA).select("layer", "path", "line", "rule", "value", "severity")


def image_files(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.lit("l").alias("layer"), F.concat(F.when(k % 7 == 0, "a/.wh.x/").otherwise("a/"), k.cast("string")).alias("path"), F.when(k % 5 == 0, "link").otherwise("file").alias("kind"),
        F.when(k % 11 == 0, F.lit(b"a\0b")).when(k % 13 == 0, F.lit(b"a\xffb")).otherwise(F.coalesce("text", F.lit("")).cast("binary")).alias("content"),
    )
    return S.image_files(rows, 3000).select("path", F.md5("text").alias("text"))


def finding_blame(spark, sf_dir):
    f = _findings(spark, sf_dir).select("path", "line", "rule")
    blame = f.where("line % 2 = 1").select("path", "line").distinct().withColumns({"author": F.lit("A"), "mail": F.lit("a@b.c"), "commit": F.md5("path")})
    return S.blamed(f, blame)


def triage_context(spark, sf_dir):
    f = _findings(spark, sf_dir).select("path", "line", "rule")
    lines = doc_lines(spark, sf_dir).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "line", "content")
    return S.context(f, lines, 2).select("path", "line", "rule", F.md5("context").alias("context"))


def redact_files(spark, sf_dir):
    hits = S.active_hits(S.pattern_hits(doc_lines(spark, sf_dir), EXTRA)).where("rule in ('Token Assignment', 'IPv4 Address')")
    found = hits.select(F.col("doc_id").alias("path"), "line", "value", "ordinal")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return S.redactions(files, found).select("path", F.md5("text").alias("text"), "redacted")


def report_gitlab(spark, sf_dir):
    return R.gitlab(_findings(spark, sf_dir))


def report_summary(spark, sf_dir):
    return R.summary(_findings(spark, sf_dir).select("path", "line", "rule", "severity"))


def report_workflow(spark, sf_dir):
    f = _findings(spark, sf_dir).select("path", (F.col("line") - 1).cast("int").alias("line"), "rule")
    return R.workflow_json(f)


def report_otlp(spark, sf_dir):
    return R.otlp(_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("findings")))


def report_prometheus(spark, sf_dir):
    return R.prometheus(_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("findings")))


def report_provenance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.provenance_rows(o.select(F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderstatus") == "F", "tool").alias("tool"), F.col("o_custkey").alias("lines")))


_KEYED = _EXTRA + """,
f AS (
  SELECT half, rule, path, match, min(line) AS line FROM (SELECT doc_id % 3 = 0 AS half, rule, 'src/' || doc_id % 40 || '.txt' AS path, match, line FROM findings) GROUP BY ALL
),
k AS (SELECT *, md5(rule || '|' || path || '|' || match || '|' || line % 3) AS fingerprint FROM f),
h AS (SELECT * FROM k WHERE half),
b AS (SELECT * FROM k WHERE NOT half)"""


def _known(name: str, left: str, right: str) -> str:
    """With one finding a path, rule and match on each side, nearest is the one there is."""
    return f"""
{name}_1 AS (SELECT l.*, CASE WHEN r.fingerprint IS NOT NULL THEN 'exact' WHEN r.match IS NOT NULL THEN 'shifted' END AS how FROM {left} l LEFT JOIN {right} r ON l.rule = r.rule AND l.path = r.path AND l.match = r.match),
{name}_r AS (SELECT r.* FROM {right} r ANTI JOIN {left} l ON l.rule = r.rule AND l.path = r.path AND l.match = r.match),
{name}_m AS (
  SELECT x.rule, x.match, y.path AS moved_from FROM (SELECT rule, match FROM {name}_1 WHERE how IS NULL GROUP BY ALL HAVING count(*) = 1) x
  JOIN (SELECT rule, match, min(path) AS path FROM {name}_r GROUP BY rule, match HAVING count(*) = 1) y ON x.rule = y.rule AND x.match = y.match
),
{name} AS (
  SELECT i.* EXCLUDE (how), CASE WHEN i.how = 'exact' AND r.fingerprint <> i.fingerprint THEN 'shifted' ELSE coalesce(i.how, CASE WHEN m.match IS NOT NULL THEN 'moved' END) END AS how, CASE WHEN i.how IS NULL THEN m.moved_from END AS moved_from
  FROM {name}_1 i LEFT JOIN {name}_m m ON i.rule = m.rule AND i.match = m.match LEFT JOIN {right} r ON i.rule = r.rule AND i.path = r.path AND i.match = r.match
)"""


QUERIES = {f.__name__: f for f in (
    suppression_known, suppression_pass, suppression_unclaimed, finding_subjects, baseline_read, baseline_update, baseline_migration, exception_migration, triage_answers, scan_history, scan_image, image_files, finding_blame,
    triage_context, redact_files, report_gitlab, report_summary, report_workflow, report_otlp, report_prometheus, report_provenance,
)}
ORACLES = {
    "suppression_known": _KEYED + "," + _known("j", "h", "b") + " SELECT path, rule, match, how, moved_from FROM j",
    "suppression_pass": _KEYED + """,
e AS (SELECT *, CASE WHEN rule = 'License Line' AND regexp_matches(path, '^src/1[^/]*\\.txt$') THEN 'E1' WHEN rule = 'License Line' AND regexp_matches(path, '^src/2[^/]*\\.txt$') THEN 'E2' END AS x FROM h),
o AS (SELECT * FROM e WHERE x IS NULL OR x = 'E1'),
b1 AS (SELECT * FROM b WHERE rule = 'License Line'), b2 AS (SELECT * FROM b WHERE rule = 'IPv4 Address'),""" + _known("s", "o", "b1") + """,
o2 AS (SELECT * EXCLUDE (how, moved_from) FROM s WHERE how IS NULL),""" + _known("t", "o2", "b2") + """
SELECT path, rule, match, 'exception' AS verdict, 'E2' AS detail FROM e WHERE x = 'E2'
UNION ALL SELECT path, rule, match, 'base', how || coalesce(' from ' || moved_from, '') FROM s WHERE how IS NOT NULL
UNION ALL SELECT path, rule, match, CASE WHEN how IS NOT NULL THEN 'baseline' END, CASE WHEN how IS NOT NULL THEN how || coalesce(' from ' || moved_from, '') WHEN x = 'E1' THEN 'E1 expired' END FROM t""",
    "suppression_unclaimed": _KEYED + "," + _known("j", "h", "b") + " SELECT rule, path, match FROM j_r ANTI JOIN j_m USING (rule, match)",
    "finding_subjects": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'src/' || p_partkey WHEN 1 THEN 'src/' || p_partkey WHEN 2 THEN 'https://h/x' WHEN 3 THEN 'src/' || p_partkey ELSE '' END AS path,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 0 END AS BIGINT) AS line, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'npm:' || p_brand ELSE '' END AS match FROM part""",
    "baseline_read": """SELECT l_suppkey AS file, CAST(CASE l_suppkey % 3 WHEN 0 THEN 1 ELSE 2 END AS INT) AS version, CASE l_suppkey % 3 WHEN 1 THEN 'scan' END AS tool, l_returnflag AS rule, 'a/' || l_partkey AS path, l_orderkey AS line,
  CASE l_suppkey % 3 WHEN 1 THEN md5(CAST(l_orderkey AS VARCHAR)) END AS fingerprint FROM lineitem WHERE l_suppkey % 3 < 2
UNION ALL SELECT DISTINCT l_suppkey, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem WHERE l_suppkey % 3 = 2""",
    "baseline_update": _KEYED + """,
e AS (SELECT 'licences' AS tool, path FROM b WHERE rule = 'License Line' UNION ALL SELECT 'scan', path FROM h)
SELECT tool, count(*) AS entries, min(path) AS first, max(path) AS last FROM e GROUP BY tool""",
    "baseline_migration": _KEYED + " SELECT 'scan' AS tool, fingerprint, rule, path, line FROM h WHERE (path, rule, line) IN (SELECT (path, rule, line) FROM k WHERE line % 2 = 0)",
    "exception_migration": "SELECT DISTINCT 'CVE-' || p_size AS id, 'OSV/CVE-' || p_size AS rule, 'sec' AS owner, '2025-01-31' AS expires FROM part WHERE p_size NOT IN (7, 9)",
    "triage_answers": """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'real' ELSE 'uncertain' END AS verdict,
  round(CAST(CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 10) / 10.0 WHEN 1 THEN 1.0 ELSE 0.5 END AS DOUBLE), 6) AS confidence, p_partkey % 4 = 0 AND p_partkey % 10 >= 5 AS suppressed FROM part""",
    "scan_history": _EXTRA + "SELECT doc_id % 97 AS commit, CAST(doc_id AS VARCHAR) AS path, line, rule, value, 'medium' AS severity FROM findings JOIN lines USING (doc_id, line) WHERE NOT contains(content, 'Licensed under')",
    "scan_image": _EXTRA + """,
i AS (SELECT 'layer' || doc_id % 2 AS layer, 'app/' || doc_id // 2 || CASE WHEN doc_id % 4 < 2 THEN '/.env' ELSE '/x.txt' END AS path, line, rule, value FROM findings)
SELECT min(layer) AS layer, path, line, rule, value, CASE WHEN contains(path, '.env') THEN 'high' ELSE 'medium' END AS severity FROM i GROUP BY ALL""",
    "image_files": """SELECT 'a/' || doc_id AS path, md5(CASE WHEN doc_id % 13 = 0 THEN 'a�b' ELSE coalesce(text, '') END) AS text FROM documents
WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND (doc_id % 13 = 0 OR strlen(coalesce(text, '')) <= 3000)""",
    "finding_blame": _EXTRA + "SELECT path, line, rule, CASE WHEN line % 2 = 1 THEN 'A <a@b.c> @ ' || substr(md5(path), 1, 8) END AS author FROM findings",
    "triage_context": _EXTRA + """,
c AS (SELECT f.path, f.line, string_agg(lpad(CAST(l.line AS VARCHAR), 4, ' ') || ' | ' || l.content, chr(10) ORDER BY l.line) AS context FROM (SELECT DISTINCT doc_id, path, line FROM findings) f JOIN lines l ON l.doc_id = f.doc_id AND l.line BETWEEN f.line - 2 AND f.line + 2 GROUP BY ALL)
SELECT f.path, f.line, f.rule, md5(c.context) AS context FROM findings f JOIN c ON f.path = c.path AND f.line = c.line""",
    "redact_files": _EXTRA + """,
t AS (SELECT doc_id, line, max(value) FILTER (rule = 'Token Assignment') AS a, max(value) FILTER (rule = 'IPv4 Address') AS b, count(*) AS n FROM findings WHERE rule IN ('Token Assignment', 'IPv4 Address') GROUP BY ALL),
s AS (
  SELECT l.doc_id, l.line, content, t.n, CASE WHEN a IS NULL THEN content ELSE substr(content, 1, instr(content, a) - 1) || '<REDACTED>' || substr(content, instr(content, a) + length(a)) END AS x, b FROM lines l LEFT JOIN t ON l.doc_id = t.doc_id AND l.line = t.line
),
u AS (SELECT *, CASE WHEN b IS NULL OR instr(x, b) = 0 THEN x ELSE substr(x, 1, instr(x, b) - 1) || '<REDACTED>' || substr(x, instr(x, b) + length(b)) END AS y FROM s),
j AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY line) AS body, CAST(sum(n) AS INT) AS redacted FROM u GROUP BY doc_id)
SELECT j.doc_id AS path, md5(body || CASE WHEN ends_with(d.text, chr(10)) THEN chr(10) ELSE '' END) AS text, redacted FROM j JOIN documents d ON j.doc_id = d.doc_id WHERE redacted IS NOT NULL""",
    "report_gitlab": _EXTRA + "SELECT path, line, rule, 'Medium' AS severity, 'sievework-' || md5(path || '|' || line || '|' || rule) AS id FROM findings",
    "report_summary": _EXTRA + """,
n AS (SELECT count(*) AS n FROM findings),
r AS (SELECT string_agg('| `' || path || '` | ' || line || ' | `' || rule || '` | **medium** |', chr(10) ORDER BY path, line, rule) AS t FROM (SELECT * FROM findings ORDER BY path, line, rule LIMIT 20))
SELECT '**' || n || ' finding(s)** (0 critical, 0 high, ' || n || ' medium, 0 low)' || chr(10) || chr(10) || '| File | Line | Rule | Severity |' || chr(10) || '|---|---|---|---|' || chr(10) || t
  || CASE WHEN n > 20 THEN chr(10) || chr(10) || '_...and ' || (n - 20) || ' more._' ELSE '' END AS summary FROM n, r""",
    "report_workflow": _EXTRA + """SELECT path, CAST(line - 1 AS INT) AS line, rule, '{"path":"' || path || '","line":' || (line - 1) || ',"rule":"' || rule || '"}' AS json, CAST(greatest(line - 1, 1) AS INT) AS start_line FROM findings""",
    "report_otlp": _EXTRA + """SELECT 'medium' AS severity, '{"name":"sievework.findings","gauge":{"dataPoints":[{"attributes":[{"key":"severity","value":{"stringValue":"medium"}}],"asInt":"' || count(*) || '"}]}}' AS metric FROM findings""",
    "report_prometheus": _EXTRA + """SELECT 'sievework_findings{severity="medium"} ' || count(*) AS metric FROM findings""",
    "report_provenance": """SELECT o_orderkey AS hash, '{"hash":' || o_orderkey || ',"tool":"tool","lines":' || o_custkey || '}' AS json FROM orders WHERE o_orderstatus = 'F'""",
}
