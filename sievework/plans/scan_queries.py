"""Text scan, report and suppression over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as P
from ..functions import text as T
from ..operators import report as R
from ..operators import scan as S
from ..operators import suppress as U

#: Patterns that occur in the driver tables; a project's own extra patterns take this form.
EXTRA = [
    ("Token Assignment", r'token = "[0-9a-f]{40}"'),
    ("Card Number", r"\b[0-9]{16}\b"),
    ("IPv4 Address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("License Line", r"(?:Licensed|Released) under [A-Z][A-Za-z]+"),
]
EMAIL = T.PATTERNS[-1][1]
MARK = "Licensed under"
SALT = bytes(range(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark, sf_dir) -> DataFrame:
    return T.lines(table(spark, sf_dir, "documents"), "doc_id")


def scan_line_index(spark, sf_dir):
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("content")).alias("longest"))


def scan_email_raw(spark, sf_dir):
    return S.pattern_hits(doc_lines(spark, sf_dir), [("Generic PII (Email)", EMAIL)]).select("doc_id", "line", "value")


def scan_placeholder_split(spark, sf_dir):
    hits = S.pattern_hits(doc_lines(spark, sf_dir), [(n, p) for n, p, _ in T.PATTERNS] + EXTRA)
    return hits.withColumn("active", ~T.false_positive(F.col("value"))).groupBy("rule", "active").agg(F.count("*").alias("lines"))


def scan_extra_patterns(spark, sf_dir):
    return S.active_hits(S.pattern_hits(doc_lines(spark, sf_dir), EXTRA)).select("doc_id", "line", "rule", "value")


def scan_rule_severity_rollup(spark, sf_dir):
    found = S.scan(table(spark, sf_dir, "documents"), "doc_id", extra=EXTRA)
    return R.severity_totals(found).select("severity", "rule", "findings", "level")


def scan_entropy_tokens(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).where(F.length("content") >= T.MIN_LENGTH).select("doc_id", "line", F.explode(T.tokens(F.col("content"))).alias("token"))
    kept = rows.where(F.octet_length("token") >= T.MIN_LENGTH)
    return kept.select("doc_id", "line", "token", T.charset(F.col("token")).alias("kind"), F.round(T.entropy(F.col("token")), 6).alias("bits"))


def scan_entropy_noise(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).where(F.length("content") >= T.MIN_LENGTH).select("content", F.explode(T.tokens(F.col("content"))).alias("token")).where(F.octet_length("token") >= T.MIN_LENGTH)
    return rows.groupBy(T.charset(F.col("token")).alias("kind"), T.digest_shaped(F.col("token"), F.col("content")).alias("noise")).agg(F.count("*").alias("tokens"))


def scan_redact(spark, sf_dir):
    pattern = EXTRA[0][1]
    rows = doc_lines(spark, sf_dir).where(F.col("content").rlike(pattern))
    return rows.select("doc_id", "line", S.redacted(F.col("content"), pattern).alias("redacted"))


def scan_first_match_only(spark, sf_dir):
    pattern = EXTRA[2][1]
    rows = doc_lines(spark, sf_dir).where(F.col("content").rlike(pattern))
    return rows.agg(F.count("*").alias("findings"), F.sum(F.regexp_count("content", F.lit(pattern))).cast("long").alias("matches"))


def scan_ignore_carry(spark, sf_dir):
    rows = S.ignores(doc_lines(spark, sf_dir), "doc_id", MARK)
    return rows.where("reason is not null").select("doc_id", "line", "reason")


def scan_key_blocks(spark, sf_dir):
    """Key blocks opened and closed by lines of the data: a licence line opens one, a token line closes it."""
    lines = doc_lines(spark, sf_dir).withColumn(
        "content",
        F.when(F.col("content").contains(MARK), F.lit("-----BEGIN PUBLIC KEY-----")).when(F.col("content").contains("token ="), F.lit("-----END PUBLIC KEY-----")).otherwise(F.col("content")),
    )
    return S.in_key_block(lines, "doc_id").where("pem").groupBy("doc_id").agg(F.count("*").alias("lines"))


def _findings(spark, sf_dir):
    hits = S.active_hits(S.pattern_hits(doc_lines(spark, sf_dir), EXTRA))
    return hits.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "line", "rule", S.severity(F.col("rule")).alias("severity"), "value", "doc_id")


def report_status(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    checks = labels.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("toxic") == 1, "incomplete").otherwise("passed").alias("status"))
    out = R.status(_findings(spark, sf_dir).where("rule = 'Token Assignment'"), checks)
    return out.select("findings", "worst_check", "status", R.exit_code(F.col("status"), F.col("worst_check"), F.lit(True), F.lit(False)).alias("waived_exit"), R.exit_code(F.col("status"), F.col("worst_check"), F.lit(False), F.lit(True)).alias("exit"))


def report_sarif_rows(spark, sf_dir):
    return R.sarif_results(_findings(spark, sf_dir)).select("path", "line", "rule", F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine").cast("int").alias("start_line"))


def report_junit_rows(spark, sf_dir):
    return R.junit(_findings(spark, sf_dir))


def report_annotation_batches(spark, sf_dir):
    return R.annotation_batches(_findings(spark, sf_dir), 2).select("path", "line", "rule", "batch")


def _halves(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("match", F.md5("value")).withColumn("fingerprint", F.md5(F.concat_ws("|", "rule", "value")))
    return f.where("doc_id % 2 = 0"), f.where("doc_id % 2 = 1")


def baseline_exact(spark, sf_dir):
    head, base = _halves(spark, sf_dir)
    return U.exact(head, base).select("path", "line", "rule", "known")


def baseline_moved(spark, sf_dir):
    head, base = _halves(spark, sf_dir)
    return U.moved(head, base).select("rule", "match", "path", "line", "old_path", "old_line")


def baseline_shifted(spark, sf_dir):
    head, base = _halves(spark, sf_dir)
    numbered = [U.occurrences(x.withColumn("path", F.lit("all"))).select("rule", "path", "match", F.col("line").cast("long"), F.col("occurrence").cast("long")) for x in (head, base)]
    return U.shifted(*numbered)


def baseline_unclaimed(spark, sf_dir):
    head, base = _halves(spark, sf_dir)
    return U.unclaimed(base, head).groupBy("fingerprint").agg(F.count("*").alias("n"))


def new_since_anti(spark, sf_dir):
    head, base = _halves(spark, sf_dir)
    return U.new_since(head.select("rule", "value"), base.select("rule", "value")).groupBy("rule", "value").agg(F.count("*").alias("n"))


EXCEPTIONS = [
    {"id": "E1", "rule": "License Line", "path": "src/1*.txt", "reason": "ours", "owner": "legal", "expires": "2024-06-30"},
    {"id": "E2", "rule": "License Line", "reason": "text only", "owner": "legal", "expires": "2024-07-08"},
    {"id": "E3", "path": "src/2?.txt", "reason": "fixture", "owner": "qa", "expires": "2025-01-01"},
]


def exception_theta(spark, sf_dir):
    judged = U.exceptions(_findings(spark, sf_dir), EXCEPTIONS, F.lit("2024-07-01").cast("date"))
    return judged.select("path", "line", "rule", "exception", "expired", "suppressed")


def exception_expiring(spark, sf_dir):
    return U.expiring(U.exceptions(_findings(spark, sf_dir), EXCEPTIONS, F.lit("2024-07-01").cast("date")))


def suppression_tally(spark, sf_dir):
    judged = U.exceptions(_findings(spark, sf_dir), EXCEPTIONS, F.lit("2024-07-01").cast("date"))
    return R.suppression_tally(judged.select(F.when(F.col("suppressed"), "exception").when(F.col("expired"), "expired").otherwise("open").alias("kind")))


def fingerprint(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.select("path", "line", "rule", P.fingerprint(SALT, F.col("rule"), F.col("path"), F.col("value"), F.lit("context")).alias("fingerprint"), P.match_hash(SALT, F.col("value")).alias("match"))


def finding_context(spark, sf_dir):
    """Up to two non-blank lines on either side of a licence line, white space collapsed."""
    kept = doc_lines(spark, sf_dir).where(F.trim("content") != "")
    around = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-2, 2)
    rows = kept.withColumn("context", F.array_join(F.collect_list(F.trim(F.regexp_replace("content", "[ \t]+", " "))).over(around), "\n"))
    return rows.where(F.col("content").contains(MARK)).select("doc_id", "line", F.md5("context").alias("context"))


_LINES = r"""
lines AS (
  SELECT doc_id, i AS line, l[i] AS content FROM (
    SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL
  ), unnest(range(1, len(l) + 1)) AS r(i)
)"""


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _hits(patterns, name="hits"):
    arms = "\n  UNION ALL ".join(f"SELECT doc_id, line, content, {i} AS ordinal, '{_sql(n)}' AS rule, regexp_extract(content, '{_sql(p)}') AS value FROM lines WHERE regexp_matches(content, '{_sql(p)}')" for i, (n, p) in enumerate(patterns))
    return f"{name} AS (\n  {arms}\n)"


_FALSE = "(" + " OR ".join([f"starts_with(lower(value), '{p}')" for p in T.SAFE_PREFIXES] + [f"contains(lower(value), '{m}')" for m in T.PLACEHOLDERS]) + ")"
_TOKENS = """
tokens AS (
  SELECT doc_id, line, content, token FROM lines, unnest(regexp_split_to_array(content, '[=:"'' \\t,;]')) AS t(token)
  WHERE length(content) >= 20 AND strlen(token) >= 20
)"""
_KIND = "CASE WHEN regexp_full_match(token, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(token, '[A-Za-z0-9+/=_-]+') THEN 'base64' ELSE 'other' END"
_NOISE = "(regexp_matches(lower(token), '^(sha1|sha256|sha384|sha512|md5)-') OR (regexp_full_match(token, '[0-9a-fA-F]+') AND length(token) IN (40, 64, 128)) OR contains(content, 'base64,'))"
_BITS = "list_aggregate(string_split(token, ''), 'entropy')"
_EXTRA = "WITH " + _LINES + ",\n" + _hits(EXTRA) + f""",
findings AS (
  SELECT 'src/' || doc_id || '.txt' AS path, line, rule, value, doc_id, md5(value) AS match, md5(rule || '|' || value) AS fingerprint FROM hits WHERE NOT {_FALSE}
),
head AS (SELECT * FROM findings WHERE doc_id % 2 = 0),
base AS (SELECT * FROM findings WHERE doc_id % 2 = 1)
"""
_INNER, _OUTER = P.pads(SALT)
_JUDGED = _EXTRA + """,
judged AS (
  SELECT *, CASE WHEN rule = 'License Line' AND regexp_matches(path, '^src/1[^/]*\\.txt$') THEN 'E1' WHEN rule = 'License Line' THEN 'E2' WHEN regexp_matches(path, '^src/2[^/]\\.txt$') THEN 'E3' END AS exception FROM findings
),
dated AS (
  SELECT *, coalesce(DATE '2024-07-01' > CASE exception WHEN 'E1' THEN DATE '2024-06-30' WHEN 'E2' THEN DATE '2024-07-08' WHEN 'E3' THEN DATE '2025-01-01' END, false) AS expired FROM judged
)
"""
_SEVERITY = "CASE rule " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, _, s in T.PATTERNS) + " ELSE 'medium' END"

QUERIES = {f.__name__: f for f in (
    scan_line_index, scan_email_raw, scan_placeholder_split, scan_extra_patterns, scan_rule_severity_rollup, scan_entropy_tokens, scan_entropy_noise, scan_redact, scan_first_match_only,
    scan_ignore_carry, scan_key_blocks, report_status, report_sarif_rows, report_junit_rows, report_annotation_batches, baseline_exact, baseline_moved, baseline_shifted, baseline_unclaimed, new_since_anti,
    exception_theta, exception_expiring, suppression_tally, fingerprint, finding_context,
)}
ORACLES = {
    "baseline_shifted": _EXTRA.replace("WITH", "WITH RECURSIVE", 1) + """,
h AS (SELECT rule, match, line, row_number() OVER (PARTITION BY rule, match ORDER BY line) - 1 AS occurrence FROM head),
b AS (SELECT rule, match, line, row_number() OVER (PARTITION BY rule, match ORDER BY line) - 1 AS occurrence FROM base),
entries AS (SELECT rule, match, list(struct_pack(line := line, occ := occurrence)) AS free FROM b GROUP BY ALL),
step AS (
  SELECT g.rule, g.match, CAST(-1 AS BIGINT) AS occurrence, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS base_line, coalesce(free, []) AS free FROM (SELECT DISTINCT rule, match FROM h) g LEFT JOIN entries e ON g.rule = e.rule AND g.match = e.match
  UNION ALL
  SELECT rule, match, occurrence, line, best.line, list_filter(free, lambda x: x.line <> best.line OR x.occ <> best.occ) FROM (
    SELECT h.rule, h.match, h.occurrence, h.line, s.free, list_sort(list_transform(s.free, lambda x: struct_pack(d := abs(x.line - h.line), o := abs(x.occ - h.occurrence), line := x.line, occ := x.occ)))[1] AS best
    FROM step s JOIN h ON s.rule = h.rule AND s.match = h.match AND h.occurrence = s.occurrence + 1
  )
)
SELECT rule, 'all' AS path, match, line, occurrence, base_line FROM step WHERE occurrence >= 0""",
    "scan_line_index": f"WITH {_LINES} SELECT doc_id, count(*) AS lines, max(length(content)) AS longest FROM lines GROUP BY doc_id",
    "scan_email_raw": f"WITH {_LINES}, {_hits([('e', EMAIL)])} SELECT doc_id, line, value FROM hits",
    "scan_placeholder_split": f"WITH {_LINES}, {_hits([(n, p) for n, p, _ in T.PATTERNS] + EXTRA)} SELECT rule, NOT {_FALSE} AS active, count(*) AS lines FROM hits GROUP BY ALL",
    "scan_extra_patterns": _EXTRA + "SELECT doc_id, line, rule, value FROM findings",
    "scan_rule_severity_rollup": f"""WITH {_LINES}, {_hits([(n, p) for n, p, _ in T.PATTERNS] + EXTRA)}, {_TOKENS},
every AS (
  SELECT rule FROM hits WHERE NOT {_FALSE}
  UNION ALL
  SELECT CASE WHEN kind = 'hex' THEN 'High Entropy String (hex)' ELSE 'High Entropy String (base64)' END
  FROM (SELECT token AS value, token, content, {_KIND} AS kind, {_BITS} AS bits FROM tokens)
  WHERE NOT {_FALSE} AND NOT {_NOISE} AND ((kind = 'base64' AND bits > 4.5) OR (kind = 'hex' AND bits > 3.5 AND length(token) >= 32))
),
judged AS (SELECT rule, {_SEVERITY} AS severity FROM every)
SELECT severity, rule, count(*) AS findings, CAST(grouping(severity, rule) AS BIGINT) AS level FROM judged GROUP BY GROUPING SETS ((severity, rule), (severity), ())""",
    "scan_entropy_tokens": f"WITH {_LINES}, {_TOKENS} SELECT doc_id, line, token, {_KIND} AS kind, round({_BITS}, 6) AS bits FROM tokens",
    "scan_entropy_noise": f"WITH {_LINES}, {_TOKENS} SELECT {_KIND} AS kind, {_NOISE} AS noise, count(*) AS tokens FROM tokens GROUP BY ALL",
    "scan_redact": f"WITH {_LINES} SELECT doc_id, line, regexp_replace(content, '{_sql(EXTRA[0][1])}', '[REDACTED]') AS redacted FROM lines WHERE regexp_matches(content, '{_sql(EXTRA[0][1])}')",
    "scan_first_match_only": f"WITH {_LINES} SELECT count(*) AS findings, CAST(sum(len(regexp_extract_all(content, '{_sql(EXTRA[2][1])}'))) AS BIGINT) AS matches FROM lines WHERE regexp_matches(content, '{_sql(EXTRA[2][1])}')",
    "scan_ignore_carry": f"""WITH {_LINES},
own AS (
  SELECT doc_id, line, CASE WHEN contains(content, '{MARK}') THEN trim(regexp_replace(trim(substr(content, instr(content, '{MARK}') + {len(MARK)})), '^[—–: -]+', '')) END AS reason,
         starts_with(trim(content), '{MARK}') AS alone FROM lines
)
SELECT * FROM (SELECT doc_id, line, coalesce(reason, lag(CASE WHEN alone THEN reason END) OVER (PARTITION BY doc_id ORDER BY line)) AS reason FROM own) WHERE reason IS NOT NULL""",
    "scan_key_blocks": f"""WITH {_LINES},
events AS (SELECT doc_id, line, CASE WHEN contains(content, '{MARK}') THEN 'B' WHEN contains(content, 'token =') THEN 'E' END AS e FROM lines)
SELECT doc_id, count(*) AS lines FROM (
  SELECT doc_id, coalesce(e = 'B', false) OR coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'E') = 'B' AS pem FROM events
) WHERE pem GROUP BY doc_id""",
    "report_status": _EXTRA + """,
worst AS (SELECT CASE max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) WHEN 1 THEN 'incomplete' ELSE 'passed' END AS worst_check FROM labels),
n AS (SELECT count(*) AS findings FROM findings WHERE rule = 'Token Assignment'),
s AS (SELECT findings, worst_check, CASE WHEN findings > 0 THEN 'findings' ELSE worst_check END AS status FROM n, worst)
SELECT findings, worst_check, status, CAST(CASE worst_check WHEN 'passed' THEN 0 ELSE 4 END AS INT) AS waived_exit,
       CAST(CASE status WHEN 'findings' THEN 1 ELSE 0 END AS INT) AS exit FROM s""",
    "report_sarif_rows": _EXTRA + "SELECT path, line, rule, 'warning' AS level, CAST(line AS INT) AS start_line FROM findings",
    "report_junit_rows": _EXTRA + """SELECT path, line, rule, '<testcase classname="' || path || '" name="' || rule || '"><failure message="line ' || line || '"/></testcase>' AS xml FROM findings""",
    "report_annotation_batches": _EXTRA + "SELECT path, line, rule, CAST(ceil(row_number() OVER (ORDER BY path, line, rule) / 2.0) AS BIGINT) AS batch FROM findings",
    "baseline_exact": _EXTRA + """,
h AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, line) AS copy FROM head),
b AS (SELECT fingerprint, row_number() OVER (PARTITION BY fingerprint) AS copy FROM base)
SELECT h.path, h.line, h.rule, b.copy IS NOT NULL AS known FROM h LEFT JOIN b ON h.fingerprint = b.fingerprint AND h.copy = b.copy""",
    "baseline_moved": _EXTRA + """,
h AS (SELECT * FROM head QUALIFY count(*) OVER (PARTITION BY rule, match) = 1),
b AS (SELECT * FROM base QUALIFY count(*) OVER (PARTITION BY rule, match) = 1)
SELECT h.rule, h.match, h.path, h.line, b.path AS old_path, b.line AS old_line FROM h JOIN b ON h.rule = b.rule AND h.match = b.match""",
    "baseline_unclaimed": _EXTRA + "SELECT fingerprint, count(*) AS n FROM (SELECT fingerprint FROM base EXCEPT ALL SELECT fingerprint FROM head) GROUP BY fingerprint",
    "new_since_anti": _EXTRA + "SELECT rule, value, count(*) AS n FROM (SELECT rule, value FROM head EXCEPT ALL SELECT rule, value FROM base) GROUP BY ALL",
    "exception_theta": _JUDGED + "SELECT path, line, rule, exception, expired, exception IS NOT NULL AND NOT expired AS suppressed FROM dated",
    "exception_expiring": _JUDGED + "SELECT DISTINCT exception, 7 AS days_left FROM dated WHERE exception = 'E2' AND NOT expired",
    "suppression_tally": _JUDGED + "SELECT CASE WHEN exception IS NOT NULL AND NOT expired THEN 'exception' WHEN expired THEN 'expired' ELSE 'open' END AS kind, count(*) AS n FROM dated GROUP BY 1",
    "fingerprint": _EXTRA + f"""SELECT path, line, rule,
  substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(rule) || unhex('00') || encode(path) || unhex('00') || unhex(sha256(value)) || unhex(sha256('context'))))), 1, 32) AS fingerprint,
  substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('match') || unhex('00') || encode(value)))), 1, 24) AS match
FROM findings""",
    "finding_context": f"""WITH {_LINES},
kept AS (SELECT * FROM lines WHERE trim(content) <> ''),
c AS (SELECT doc_id, line, content, list(trim(regexp_replace(content, '[ \\t]+', ' ', 'g'))) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM kept)
SELECT doc_id, line, md5(array_to_string(l, chr(10))) AS context FROM c WHERE contains(content, '{MARK}')""",
}
