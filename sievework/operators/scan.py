"""The text scan: lines to findings.

A line is tested against one cheap alternation before the patterns, so most lines cost a single expression. Windows run
by file and only over files that hold a suppression marker or a key block; everything else is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .static import LANGUAGES, literal_lines

DEFAULT_SEVERITY = "medium"


def severity(rule: Column) -> Column:
    """By rule; the arms' order matters, and exact names don't match labelled variants."""
    out = F.when(rule.isin(*[n for n, _, s in T.PATTERNS if s == "critical"]), "critical")
    for level in ("high", "medium", "low"):
        out = out.when(rule.isin(*[n for n, _, s in T.PATTERNS if s == level]), level)
    # Severities of rules that are no patterns.
    return (
        out.when(rule.startswith("SAST/ChildProcess") | rule.isin("SAST/EvalUsage", "SAST/FunctionConstructor", "SAST/PythonEval", "SAST/PythonExec"), "critical")
        .when(rule.isin("SAST/PythonPickle", "SAST/PythonSubprocessShell", "SAST/GoExecCommand", "SAST/RustCommandNew"), "high")
        .when(rule == "SAST/RustUnsafeBlock", "medium")
        .when(rule.isin("SAST/RustUnwrap", "SAST/RustExpect"), "low")
        .when(rule.startswith("CI/ExpressionInjection") | (rule == "CI/PullRequestTargetWithCheckout"), "critical")
        .when(rule.startswith("CI/"), "medium")
        .when(rule.startswith("SAST/"), "high")
        .when(rule.startswith("SMELL/"), "low")
        .otherwise(DEFAULT_SEVERITY)
    )


def pattern_hits(lines: DataFrame, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """lines with rule and value: the first match of each pattern on a line, placeholders included."""
    chosen = patterns if patterns is not None else [(n, p) for n, p, _ in T.PATTERNS]
    any_ = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for _, p in chosen)
    first = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("rule"), F.regexp_substr("content", F.lit(p)).alias("value")) for i, (n, p) in enumerate(chosen)))
    rows = lines.where(F.col("content").rlike(any_)).withColumn("hit", F.explode(first)).where("hit.value is not null")
    return rows.select(*lines.columns, F.col("hit.ordinal").alias("ordinal"), F.col("hit.rule").alias("rule"), F.col("hit.value").alias("value"))


def active_hits(hits: DataFrame) -> DataFrame:
    """A pattern whose first match is a placeholder is silent for the line, whatever follows."""
    return hits.where(~T.false_positive(F.col("value")))


def in_key_block(lines: DataFrame, key: str = "path") -> DataFrame:
    """lines with ``pem``: from a key block's first line to its last; entropy doesn't count there."""
    bare = F.ltrim("content")
    begin, end = (bare.startswith(f"-----{w}") & bare.contains("KEY-----") for w in ("BEGIN", "END"))
    event = F.when(begin, "B").when(end, "E")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("pem", begin | (F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit("E")) == "B"))


def entropy_hits(lines: DataFrame) -> DataFrame:
    """lines with rule and value of each flagged token; lines may carry ``pem``."""
    rows = lines.where(~F.col("pem")) if "pem" in lines.columns else lines
    token = F.col("value")
    exploded = rows.where(F.length("content") >= T.MIN_LENGTH).withColumn("value", F.explode(T.tokens(F.col("content")))).where(F.octet_length("value") >= T.MIN_LENGTH)
    kept = exploded.where(~T.digest_shaped(token, F.col("content")) & ~T.false_positive(token) & (T.charset(token) != "other"))
    return kept.withColumn("rule", T.entropy_rule(token, T.entropy(token))).where("rule is not null")


def ignores(lines: DataFrame, key: str = "path", marker: str = T.MARKER, following: bool = False) -> DataFrame:
    """lines with ``reason``: null if nothing covers the line. A standalone marker covers the next line, one's own reason wins;
    static rules also take a marker on the line after."""
    order = Window.partitionBy(key).orderBy("line")
    own = T.ignore_reason(F.col("content"), marker)
    above = F.lag(F.when(T.standalone(F.col("content"), marker), own)).over(order)
    arms = [own, above] + ([F.lead(own).over(order)] if following else [])
    return lines.withColumn("reason", F.coalesce(*arms))


def scan(files: DataFrame, key: str = "path", text: str = "text", extra: list[tuple[str, str]] | None = None, entropy: bool = True, marker: str = T.MARKER) -> DataFrame:
    """key, line, rule, severity, value and suppressed (null: active, else the reason) of all findings."""
    # Only files with a marker or a key block have states that go from line to line; the others' lines stand alone and aren't shuffled.
    special = F.coalesce(F.col(text).contains(marker) | F.col(text).contains("-----BEGIN") | F.col(text).contains("-----END"), F.lit(False))
    alone = T.lines(files.where(~special), key, text).withColumns({"pem": F.lit(False), "reason": F.lit(None).cast("string")})
    rows = alone.unionByName(ignores(in_key_block(T.lines(files.where(special), key, text), key), key, marker))
    found = active_hits(pattern_hits(rows, [(n, p) for n, p, _ in T.PATTERNS] + (extra or []))).select(key, "line", "rule", "value", "reason")
    if entropy:
        found = found.unionByName(entropy_hits(rows).select(key, "line", "rule", "value", "reason"))
    return found.select(key, "line", "rule", severity(F.col("rule")).alias("severity"), "value", F.col("reason").alias("suppressed"))


def scan_project(files: DataFrame, extra: list[tuple[str, str]] | None = None, entropy: bool = True, marker: str = T.MARKER) -> DataFrame:
    """path, line, rule, severity, value and suppressed of all findings where static analysis is on: of source files only the string literals count, each at its
    first line and suppressed by a marker there, above or below; all other files are scanned by lines."""
    source = F.coalesce(F.col("path").rlike(r"\.(?:" + "|".join(LANGUAGES) + ")$"), F.lit(False))
    code = files.where(source)
    spoken = literal_lines(code)
    found = active_hits(pattern_hits(spoken, [(n, p) for n, p, _ in T.PATTERNS] + (extra or []))).select("path", "line", "rule", "value")
    if entropy:
        found = found.unionByName(entropy_hits(spoken).select("path", "line", "rule", "value"))
    marked = ignores(T.lines(code.where(F.contains("text", F.lit(marker))), "path"), "path", marker, following=True).where("reason is not null").select("path", "line", F.col("reason").alias("suppressed"))
    judged = found.withColumn("severity", severity(F.col("rule"))).join(marked, ["path", "line"], "left")
    return scan(files.where(~source), "path", extra=extra, entropy=entropy, marker=marker).unionByName(judged)


def split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, suppressed) findings."""
    return findings.where("suppressed is null"), findings.where("suppressed is not null")


def checked_patterns(extra: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A project's own patterns, tried in the driver, so that a bad one is an error before anything runs."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for name, pattern in extra:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            raise ValueError(f"pattern {name!r} can't be read: {pattern}") from e
    return list(extra)


def history(added: DataFrame, extra: list[tuple[str, str]] | None = None, entropy: bool = True, marker: str = T.MARKER) -> DataFrame:
    """Findings in lines that a history added (commit, path, line, content): a line with the marker is left out as a whole, and no line covers another."""
    rows = added.where(~F.col("content").contains(marker))
    found = active_hits(pattern_hits(rows, [(n, p) for n, p, _ in T.PATTERNS] + (extra or [])))
    columns = ["commit", "path", "line", "rule", "value"]
    out = found.select(*columns)
    if entropy:
        out = out.unionByName(entropy_hits(rows).select(*columns))
    return out.withColumn("severity", severity(F.col("rule")))


# Parts and ends of paths that hold credentials.
SENSITIVE = r"\.env|\.aws/credentials|\.ssh/|etc/environment|docker-compose|\.(?:pem|key|p12|pfx)$"


def image(files: DataFrame, extra: list[tuple[str, str]] | None = None, entropy: bool = False) -> DataFrame:
    """Findings in an image's layers (layer, path, text): suppressions don't count there, medium ones are high in places that hold credentials, and
    one found again in another layer at the same path and line is one finding, of the first layer by name."""
    rows = T.lines(files.withColumn("__at", F.struct("layer", "path")), "__at").select(F.col("__at.layer").alias("layer"), F.col("__at.path").alias("path"), "line", "content")
    found = active_hits(pattern_hits(rows, [(n, p) for n, p, _ in T.PATTERNS] + (extra or []))).select("layer", "path", "line", "rule", "value")
    if entropy:
        found = found.unionByName(entropy_hits(rows).select("layer", "path", "line", "rule", "value"))
    level = severity(F.col("rule"))
    found = found.withColumn("severity", F.when((level == "medium") & F.col("path").rlike(SENSITIVE), "high").otherwise(level))
    return found.groupBy("path", "line", "rule", "value", "severity").agg(F.min("layer").alias("layer"))


def image_layers(entries: DataFrame) -> DataFrame:
    """image, layer and at (its place) of the layer archives that the manifests of saved images (image, path, text) name, in either layout, where they are there; of a layer named twice
    in a row once. An image without a manifest that names any has its layer.tar files, by path. Names that lead outside the archive are none."""
    schema = "array<struct<Layers: array<string>>>"
    normal = lambda p: ~p.rlike(r"^/|(?:^|/)\.{1,2}(?:/|$)") & (p != "")
    named = entries.where("path = 'manifest.json'").select("image", F.posexplode(F.filter(F.flatten(F.filter(F.transform(F.from_json("text", schema), lambda m: m["Layers"]), lambda x: x.isNotNull())), lambda p: p.isNotNull() & normal(p))).alias("at", "layer"))
    named = named.join(entries.select("image", F.col("path").alias("layer")), ["image", "layer"], "left_semi")
    order = Window.partitionBy("image").orderBy("at")
    named = named.withColumn("before", F.lag("layer").over(order)).where("before is null or before <> layer")
    bare = entries.where(F.col("path").rlike("(?:^|/)layer\\.tar$")).join(named.select("image").distinct(), "image", "left_anti").select("image", F.col("path").alias("layer"))
    place = lambda df, by: df.withColumn("at", F.row_number().over(Window.partitionBy("image").orderBy(by))).select("image", "layer", "at")
    return place(named, "at").unionByName(place(bare, "layer"))


def image_files(entries: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Files of layers (layer, path, kind, content binary) that are read: no links, no whiteouts, nothing large, nothing binary; with their text."""
    name = F.element_at(F.split("path", "/"), -1)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".wh."))
    rows = entries.where((F.col("kind") == "file") & ~hidden & (F.length(name) > 0) & (F.octet_length("content") <= most) & (F.position(F.lit(b"\0"), F.col("content")) == 0))
    return rows.select("layer", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def blamed(findings: DataFrame, blame: DataFrame) -> DataFrame:
    """findings with ``author``: who last touched the line, as name, mail and short commit; null where it isn't known."""
    who = F.concat(F.col("author"), F.lit(" <"), F.col("mail"), F.lit("> @ "), F.substring("commit", 1, 8))
    return findings.join(blame.select("path", "line", who.alias("author")), ["path", "line"], "left")


def context(findings: DataFrame, lines: DataFrame, around: int) -> DataFrame:
    """findings (path, line) with ``context``: the lines around, numbered. Each finding asks for its own few lines, by an equal join."""
    asked = findings.select("path", "line").distinct().select("path", F.col("line").alias("of"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)).alias("line"))
    shown = F.concat(F.lpad(F.col("line").cast("string"), 4, " "), F.lit(" | "), F.col("content"))
    got = asked.join(lines.select("path", "line", "content"), ["path", "line"]).groupBy("path", "of").agg(F.sort_array(F.collect_list(F.struct("line", shown.alias("t")))).alias("c"))
    return findings.join(got.select("path", F.col("of").alias("line"), F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("context")), ["path", "line"], "left")


def redactions(files: DataFrame, findings: DataFrame, mark: str = "<REDACTED>") -> DataFrame:
    """path, text and ``redacted`` (how many) of files with what findings (path, line, value) matched replaced in their lines, in their order; line endings stay."""
    per_line = findings.where("value <> ''").groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).alias("v"))
    per_file = per_line.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("int"), F.transform("v", lambda x: x["value"])))).alias("at"))
    at = lambda a, v: F.position(v, a)
    first = lambda a, v: F.when(at(a, v) > 0, F.concat(F.substr(a, F.lit(1), at(a, v) - 1), F.lit(mark), F.substr(a, at(a, v) + F.length(v)))).otherwise(a)
    line = lambda l, i: F.aggregate(F.coalesce(F.element_at("at", i + 1), F.array().cast("array<string>")), l, first)  # noqa: E731, E741
    body = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    return files.join(per_file, "path").select("path", body.alias("text"), F.aggregate(F.map_values("at"), F.lit(0), lambda a, v: a + F.size(v)).alias("redacted"))


def redacted(line: Column, pattern: str, mark: str = "[REDACTED]") -> Column:
    """The line with the first match of the pattern replaced."""
    at = F.regexp_instr(line, F.lit(pattern))
    return F.when(at > 0, F.overlay(line, F.lit(mark), at, F.length(F.regexp_substr(line, F.lit(pattern))))).otherwise(line)
