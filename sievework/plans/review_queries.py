"""Coverage, complexity, provenance, affected tests, line rules, script signals and monitoring, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lint as N
from ..operators import report as R
from ..operators import review as V
from ..streaming import watch as M
from .scan_queries import doc_lines, table

PATH = "CASE WHEN l_suppkey % 2 = 0 THEN 'src/' ELSE 'lib/' END || l_suppkey || '.py'"


def _coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.expr(PATH).alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(0).alias("hits"))


def coverage_gate(spark, sf_dir):
    rows = _coverage(spark, sf_dir).select("path", (F.col("hits") > 0).cast("long").alias("hit"), F.lit(1).alias("found"))
    return V.coverage_gate(rows, 50.0)


def new_code_coverage(spark, sf_dir):
    """Lines from the sixth on are in no report: they count as unmeasured."""
    hits = _coverage(spark, sf_dir).groupBy("path", "line").agg(F.max(F.when(F.col("line") <= 5, F.col("hits"))).alias("hits"))
    added = _coverage(spark, sf_dir).select("path", "line").distinct()
    return V.new_code_coverage(added, hits)


def new_code_gate(spark, sf_dir):
    return V.new_code_gate(new_code_coverage(spark, sf_dir), 60.0)


def coverage_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//[^/]+/([^?#]*)", 1).alias("path")).where("path <> ''").distinct()
    files = pages.select(F.concat(F.lit("root/"), "path").alias("path")).unionByName(pages.where("path like 'en/%'").select(F.substr("path", F.lit(4)).alias("path"))).where("path <> ''")
    return V.coverage_file(pages, files)


def complexity_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("change")).agg(F.sum("l_quantity").cast("long").alias("added"), F.count("*").alias("files"), F.sum("l_linenumber").alias("nodes"), F.sum(F.col("l_suppkey")).alias("removed"))
    return V.complexity(rows).select("change", "score", "minutes", "tier")


def provenance_share(spark, sf_dir):
    message = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 5 == 0, "\nCo-Authored-By: Cursor Agent").when(F.col("turn") % 7 == 0, "\nAssisted-by: the aider tool").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select(V.ai_tool(F.col("role"), F.lit("a@b.invalid"), message).alias("tool"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("added"))
    return V.ai_share(rows)


def provenance_tools(spark, sf_dir):
    name = F.when(F.col("turn") % 3 == 0, "copilot[bot]").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select(V.ai_tool(name, F.lit("x"), F.coalesce("text", F.lit(""))).alias("tool"))
    return rows.groupBy("tool").agg(F.count("*").alias("commits"))


def tia_select(spark, sf_dir):
    """Pages are tests whose path is what they import; those under an id divisible by ten have changed."""
    path = F.regexp_extract("url", "//[^/]+/([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where("path <> ''")
    tests = pages.select(F.col("page_id").alias("test"), F.col("path").alias("import"))
    return V.affected_tests(tests, pages.where("page_id % 10 = 0").select(F.concat(F.regexp_replace("path", r"\.html$", ""), F.lit(".ts")).alias("path")))


def html_sinks(spark, sf_dir):
    rules = {"script": "<script", "handler": r"\son[a-z]+=", "style": "<style", "frame": "<iframe", "comment": "<!--"}
    counts = [F.regexp_count(F.coalesce("html", F.lit("")), F.lit(p)).alias(k) for k, p in rules.items()]
    return table(spark, sf_dir, "pages").select("page_id", *counts)


def script_signals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(N.script_signals(F.coalesce("html", F.lit(""))), ",").alias("signals"))


def _run_together():
    """Pages' words run together, so that some hold runs long enough."""
    return F.regexp_replace(F.coalesce("html", F.lit("")), "[^A-Za-z0-9]+", "")


def blob_longest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.longest_blob(_run_together()).cast("long").alias("longest"))


def workflow_rules(spark, sf_dir):
    """Lines of documents as steps: the token lines become uses of actions."""
    c = F.col("content")
    token = F.regexp_extract(c, "([0-9a-f]{40})", 1)
    line = F.when(token != "", F.concat(F.lit("  - uses: org/action@"), F.when(F.col("doc_id") % 2 == 0, token).otherwise("v1"))).when(c.contains("Licensed under"), F.lit("  run: echo ${{ github.event.issue.title }}")).otherwise(c)
    return N.workflow_rules(doc_lines(spark, sf_dir).select("doc_id", "line", line.alias("content"))).select("doc_id", "line", "rule")


def container_rules(spark, sf_dir):
    """Orders as container files, their lines as instructions."""
    text = F.element_at(F.array(*map(F.lit, [
        "FROM node:latest", "RUN apt-get update", "RUN apt-get install -y curl", "ADD a.txt /a", "USER root", "ENV API_TOKEN=x", "HEALTHCHECK CMD true",
    ])), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), text.alias("content"))
    return N.container_rules(rows).groupBy("rule").agg(F.count("*").alias("n"))


def manifest_rules(spark, sf_dir):
    """Suppliers as deployments."""
    s = table(spark, sf_dir, "supplier")
    json = F.format_string(
        '{"kind":"%s","spec":{"template":{"spec":{"containers":[{"name":"%s","image":"app%s","resources":{%s},"securityContext":{"runAsUser":%d},"livenessProbe":{}}]}}}}',
        F.when(F.col("s_suppkey") % 3 == 0, "Job").when(F.col("s_suppkey") % 3 == 1, "Deployment").otherwise("Service"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, ":1.2").otherwise(":latest"),
        F.when(F.col("s_suppkey") % 5 == 0, '"limits":{"cpu":1}').otherwise(""), (F.col("s_suppkey") % 4).cast("int"),
    )
    return N.manifest_rules(s.select(F.col("s_suppkey").alias("path"), F.parse_json(json).alias("doc"))).groupBy("rule").agg(F.count("*").alias("n"))


def pipeline_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = lambda where: labels.where(where).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"))
    checks = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit("incomplete").alias("status"))
    findings, merged = R.merge_steps({"quality": (rows("quality = 0"), checks), "toxicity": (rows("toxic = 1"), checks.where("id is null"))})
    return findings.groupBy("step").agg(F.count("*").alias("findings")).join(merged.groupBy(F.split_part("id", F.lit("/"), F.lit(1)).alias("step")).agg(F.count("*").alias("checks"), F.max("status").alias("worst")), "step", "full_outer")


def watch_changes(spark, sf_dir):
    """Events are polls, users are files, and the time is when one was last written: new or newer ones have changed."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("poll"), F.col("ts").alias("mtime"))
    return M.changed(events).groupBy("path").agg(F.count("*").alias("changes"), F.max("mtime").alias("last"))


def watch_phantoms(spark, sf_dir):
    """Files that appeared after the start and were gone by the end."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.when(F.col("event_type").isin("view", "click"), "create").otherwise("delete").alias("kind"))
    return M.phantoms(events)


def events_windows(spark, sf_dir):
    """Tumbling hours by type, as a monitor reports them."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


_CHANGED = """
w AS (SELECT user_id AS path, ts, event_id, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)"""
_LINES = "lines AS (SELECT doc_id, i AS line, l[i] AS c FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i))"

QUERIES = {f.__name__: f for f in (
    coverage_gate, new_code_coverage, new_code_gate, coverage_paths, complexity_score, provenance_share, provenance_tools, tia_select, html_sinks, script_signals, blob_longest, workflow_rules, container_rules, manifest_rules,
    pipeline_merge, watch_changes, watch_phantoms, events_windows,
)}
ORACLES = {
    "coverage_gate": f"""WITH f AS (SELECT {PATH} AS path, sum(CASE WHEN l_returnflag = 'N' AND l_quantity >= 1 THEN 1 ELSE 0 END) AS hit, count(*) AS found FROM lineitem GROUP BY 1)
SELECT CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(found) AS BIGINT) AS found, round(100.0 * sum(hit)::DOUBLE / sum(found)::DOUBLE, 6) AS percent, count(*) FILTER (WHERE 100.0 * hit::DOUBLE / found < 50) AS files_below, 100.0 * sum(hit)::DOUBLE / sum(found)::DOUBLE >= 50 AS passed FROM f""",
    "new_code_coverage": f"""WITH a AS (SELECT {PATH} AS path, l_linenumber AS line, max(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS hits FROM lineitem GROUP BY 1, 2)
SELECT path, count(*) FILTER (WHERE line <= 5 AND hits > 0) AS covered, count(*) FILTER (WHERE line <= 5 AND hits = 0) AS uncovered, count(*) FILTER (WHERE line > 5) AS unmeasured,
  round(coalesce(100.0 * (count(*) FILTER (WHERE line <= 5 AND hits > 0))::DOUBLE / nullif(count(*) FILTER (WHERE line <= 5), 0), 100.0), 6) AS percent FROM a GROUP BY path""",
    "new_code_gate": f"""WITH f AS (WITH a AS (SELECT {PATH} AS path, l_linenumber AS line, max(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS hits FROM lineitem GROUP BY 1, 2)
SELECT path, count(*) FILTER (WHERE line <= 5 AND hits > 0) AS covered, count(*) FILTER (WHERE line <= 5 AND hits = 0) AS uncovered, count(*) FILTER (WHERE line > 5) AS unmeasured,
  round(coalesce(100.0 * (count(*) FILTER (WHERE line <= 5 AND hits > 0))::DOUBLE / nullif(count(*) FILTER (WHERE line <= 5), 0), 100.0), 6) AS percent FROM a GROUP BY path),
t AS (SELECT CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(uncovered) AS BIGINT) AS uncovered, CAST(sum(unmeasured) AS BIGINT) AS unmeasured FROM f)
SELECT *, round(coalesce(100.0 * covered::DOUBLE / nullif(covered + uncovered, 0), 100.0), 6) AS percent, round(coalesce(100.0 * covered::DOUBLE / nullif(covered + uncovered, 0), 100.0), 6) >= 60 AS passed FROM t""",
    "coverage_paths": """WITH p AS (SELECT DISTINCT regexp_extract(url, '//[^/]+/([^?#]*)', 1) AS path FROM pages),
q AS (SELECT path FROM p WHERE path <> ''),
f AS (SELECT DISTINCT file FROM (SELECT 'root/' || path AS file FROM q UNION ALL SELECT substr(path, 4) FROM q WHERE path LIKE 'en/%') WHERE file <> '')
SELECT path, file FROM q JOIN f ON string_split(path, '/')[-1] = string_split(file, '/')[-1] AND (ends_with(file, path) OR ends_with(path, file))
QUALIFY row_number() OVER (PARTITION BY path ORDER BY (file = path) DESC, length(file) DESC, file) = 1""",
    "complexity_score": """WITH c AS (SELECT l_orderkey AS change, CAST(sum(l_quantity) AS BIGINT) * 0.3::DOUBLE + count(*) * 5.0::DOUBLE + sum(l_linenumber) * 2.0::DOUBLE + sum(l_suppkey) * 0.1::DOUBLE AS raw FROM lineitem GROUP BY 1)
SELECT change, CAST(round(raw) AS BIGINT) AS score, CAST(floor(least(raw * 0.5, 120)) AS BIGINT) AS minutes,
  CASE WHEN round(raw) <= 20 THEN 'Quick Review' WHEN round(raw) <= 50 THEN 'Normal Review' WHEN round(raw) <= 100 THEN 'Complex Review' ELSE 'Large PR — consider splitting' END AS tier FROM c""",
    "provenance_share": """WITH c AS (SELECT turn % 5 = 0 OR turn % 7 = 0 AS ai, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM conversations)
SELECT CAST(coalesce(sum(n) FILTER (WHERE ai), 0) AS BIGINT) AS tool_lines, CAST(sum(n) AS BIGINT) AS lines, CAST(round(100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE ai), 0) / sum(n)) AS BIGINT) AS percent FROM c""",
    "provenance_tools": "SELECT CASE WHEN turn % 3 = 0 THEN 'GitHub Copilot' END AS tool, count(*) AS commits FROM conversations GROUP BY 1",
    "tia_select": r"""WITH p AS (SELECT page_id, regexp_extract(url, '//[^/]+/([^?#]*)', 1) AS path FROM pages),
c AS (SELECT regexp_replace(regexp_replace(path, '\.html$', '') || '.ts', '\.[^./]+$', '') AS whole FROM p WHERE path <> '' AND page_id % 10 = 0),
s AS (SELECT whole AS t FROM c UNION ALL SELECT regexp_replace(regexp_replace(whole || '.ts', '/[^/]+$', ''), '\.[^./]+$', '') FROM c),
k AS (SELECT DISTINCT array_to_string(string_split(t, '/')[i:], '/') AS stem FROM s, unnest(range(1, len(string_split(t, '/')) + 1)) AS r(i))
SELECT DISTINCT page_id AS test FROM p WHERE path <> '' AND regexp_replace(regexp_replace(path, '^[./]+', ''), '\.(js|ts|tsx|jsx|py|go|rs)$', '') IN (SELECT stem FROM k WHERE stem <> '')""",
    "html_sinks": r"SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(html, ''), '{p}')) AS INT) AS {k}" for k, p in {"script": "<script", "handler": r"\son[a-z]+=", "style": "<style", "frame": "<iframe", "comment": "<!--"}.items()) + " FROM pages",
    "script_signals": "SELECT page_id, array_to_string(list_filter([" + ", ".join("'" + s.replace("'", "''") + "'" for s in N.SCRIPT_SIGNALS) + "], lambda s: contains(coalesce(html, ''), s)), ',') AS signals FROM pages",
    "blob_longest": """SELECT page_id, list_max([CAST(length(x) AS BIGINT) FOR x IN regexp_extract_all(regexp_replace(coalesce(html, ''), '[^A-Za-z0-9]+', '', 'g'), '[A-Za-z0-9+/=_-]{120,}') IF regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')]) AS longest FROM pages""",
    "workflow_rules": f"""WITH {_LINES}, t AS (SELECT *, regexp_extract(c, '([0-9a-f]{{40}})', 1) AS tok FROM lines)
SELECT doc_id, line, 'CI/UnpinnedAction' AS rule FROM t WHERE tok <> '' AND doc_id % 2 = 1 UNION ALL SELECT doc_id, line, 'CI/ExpressionInjection' FROM t WHERE tok = '' AND contains(c, 'Licensed under')""",
    "container_rules": """WITH l AS (SELECT l_orderkey AS o, list(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1),
r AS (
  SELECT 'no-latest-image' AS rule FROM l WHERE list_contains(n, 1) UNION ALL SELECT 'apt-stale-cache' FROM l WHERE list_contains(n, 3) AND list_contains(n, 2)
  UNION ALL SELECT 'apt-no-recommends' FROM l WHERE list_contains(n, 3) UNION ALL SELECT 'prefer-copy-over-add' FROM l WHERE list_contains(n, 4)
  UNION ALL SELECT 'no-root-user' FROM l WHERE list_contains(n, 5) UNION ALL SELECT 'secret-in-env' FROM l WHERE list_contains(n, 6)
  UNION ALL SELECT 'no-user-directive' FROM l WHERE NOT list_contains(n, 5) UNION ALL SELECT 'no-healthcheck' FROM l WHERE NOT list_contains(n, 7)
) SELECT rule, count(*) AS n FROM r GROUP BY rule""",
    "manifest_rules": """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 <> 2),
r AS (
  SELECT 'no-latest-image' AS rule FROM s WHERE k % 2 = 1 UNION ALL SELECT 'no-resource-limits' FROM s WHERE k % 5 <> 0 UNION ALL SELECT 'no-memory-limit' FROM s WHERE k % 5 = 0
  UNION ALL SELECT 'run-as-root' FROM s WHERE k % 4 = 0 UNION ALL SELECT 'no-readiness-probe' FROM s WHERE k % 3 = 1
) SELECT rule, count(*) AS n FROM r GROUP BY rule""",
    "pipeline_merge": """SELECT 'quality' AS step, (SELECT count(*) FROM labels WHERE quality = 0) AS findings, (SELECT count(*) FROM labels WHERE toxic = 1) AS checks, 'incomplete' AS worst
UNION ALL SELECT 'toxicity', (SELECT count(*) FROM labels WHERE toxic = 1), 1, 'passed'""",
    "watch_changes": f"WITH {_CHANGED} SELECT path, count(*) AS changes, max(ts) AS last FROM w WHERE before IS NULL OR ts > before GROUP BY path",
    "watch_phantoms": """WITH e AS (SELECT user_id AS path, ts, event_type IN ('view', 'click') AS made FROM events)
SELECT path, min(ts) FILTER (WHERE made) AS created, max(ts) FILTER (WHERE NOT made) AS deleted FROM e GROUP BY path HAVING min(ts) FILTER (WHERE made) < max(ts) FILTER (WHERE NOT made) AND arg_max(made, ts) = false AND arg_min(made, ts)""",
    "events_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
