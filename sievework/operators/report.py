"""The report model: findings and checks roll up to one status and an exit code; renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import settled

# Ranks of statuses and severities, exit codes, SARIF and GitLab words.
CHECK_RANK = {"passed": 0, "incomplete": 1, "error": 2}
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
EXIT = {"passed": 0, "findings": 1, "error": 3, "incomplete": 4}
SARIF = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
GITLAB = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}


def mapped(column: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def status(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: findings, worst check and status. Findings win; otherwise passed < incomplete < error."""
    worst = checks.agg(F.coalesce(F.max(mapped(F.col("status"), CHECK_RANK)), F.lit(0)).alias("rank"))
    count = findings.agg(F.count("*").alias("findings"))
    named = mapped(F.col("rank"), {v: k for k, v in CHECK_RANK.items()})
    return count.crossJoin(worst).select("findings", named.alias("worst_check"), F.when(F.col("findings") > 0, "findings").otherwise(named).alias("status"))


def exit_code(status_: Column, checks: Column, no_fail: Column, warn_incomplete: Column) -> Column:
    """0, 1, 3 or 4; waived findings fall back to the checks, and incomplete may be a warning."""
    effective = F.when((status_ == "findings") & no_fail, checks).otherwise(status_)
    return F.when((effective == "incomplete") & warn_incomplete, 0).otherwise(mapped(effective, EXIT))


def severity_totals(findings: DataFrame) -> DataFrame:
    """Findings by severity, by (severity, rule), and of all, in one pass."""
    return findings.groupingSets([["severity", "rule"], ["severity"], []], "severity", "rule").agg(F.count("*").alias("findings"), F.grouping_id().alias("level"))


def suppression_tally(suppressed: DataFrame) -> DataFrame:
    return suppressed.groupBy("kind").agg(F.count("*").alias("n"))


def merge_steps(steps: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Findings and checks of all steps, check ids prefixed by the step; a silent step counts as a passed check."""
    findings, checks = None, None
    for name, (f, c) in steps.items():
        f = f.withColumn("step", F.lit(name))
        own = c.select(F.concat(F.lit(f"{name}/"), "id").alias("id"), "status")
        silent = c.sparkSession.range(1).select(F.lit(name).alias("id"), F.lit("passed").alias("status"))
        own = own.unionByName(silent.join(own.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti"))
        findings = f if findings is None else findings.unionByName(f)
        checks = own if checks is None else checks.unionByName(own)
    return findings, checks


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_report(findings: DataFrame, checks: DataFrame, command: str) -> DataFrame:
    """One JSON document; the lists are ordered. Findings are few next to what was scanned; one document holds them by nature."""
    f = findings.agg(F.sort_array(F.collect_list(F.struct("path", "line", "rule", "severity"))).alias("findings"))
    c = checks.agg(F.sort_array(F.collect_list(F.struct("id", "status"))).alias("checks"))
    return f.crossJoin(c).select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(command).alias("command"), "checks", "findings")).alias("report"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result a finding; a region only where there is a line."""
    uri = F.regexp_replace("path", r"^(\./)+", "")
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(
        "path", "line", "rule", F.to_json(F.struct(F.col("rule").alias("ruleId"), mapped(F.col("severity"), SARIF, "warning").alias("level"), F.array(place).alias("locations"))).alias("result")
    )


def sarif(findings: DataFrame, checks: DataFrame, tool: str = "sievework") -> DataFrame:
    """SARIF 2.1.0: unfinished checks are notifications, and then the run was not successful."""
    rows = sarif_results(findings).agg(F.sort_array(F.collect_list("result")).alias("results"), F.array_sort(F.collect_set("rule")).alias("rules"))
    open_ = checks.where("status <> 'passed'").agg(F.sort_array(F.collect_list("id")).alias("open"))
    text = lambda c: F.to_json(c)
    return rows.crossJoin(open_).select(
        F.concat(
            F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":'),
            text(F.transform("rules", lambda r: F.struct(r.alias("id")))),
            F.lit('}},"results":['),
            F.array_join("results", ","),
            F.lit('],"invocations":[{"executionSuccessful":'),
            F.when(F.size("open") == 0, "true").otherwise("false"),
            F.lit(',"toolExecutionNotifications":'),
            text(F.transform("open", lambda i: F.struct(F.struct(i.alias("text")).alias("message")))),
            F.lit("}]}]}"),
        ).alias("sarif")
    )


def junit(findings: DataFrame) -> DataFrame:
    """A test case element a finding."""
    e = xml_escape
    return findings.select("path", "line", "rule", F.concat(F.lit('<testcase classname="'), e(F.col("path")), F.lit('" name="'), e(F.col("rule")), F.lit('"><failure message="line '), F.col("line").cast("string"), F.lit('"/></testcase>')).alias("xml"))


def gitlab(findings: DataFrame, tool: str = "sievework") -> DataFrame:
    """A vulnerability a finding; ids name what is found where, so that they don't depend on an order of all findings."""
    return findings.select("path", "line", "rule", mapped(F.col("severity"), GITLAB, "Medium").alias("severity"), F.concat(F.lit(f"{tool}-"), F.md5(F.concat_ws("|", "path", F.col("line").cast("string"), "rule"))).alias("id"))


def workflow_json(findings: DataFrame) -> DataFrame:
    """Workflow findings as JSON objects, and as SARIF start lines: a finding about a file as a whole is on its first line there."""
    return findings.select("path", "line", "rule", F.to_json(F.struct("path", "line", "rule")).alias("json"), F.greatest(F.col("line"), F.lit(1)).alias("start_line"))


def summary(findings: DataFrame, shown: int = 20) -> DataFrame:
    """One markdown text: totals by severity and the first findings by path, line and rule."""
    n = findings.agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK))
    few = findings.orderBy("path", "line", "rule").limit(shown).agg(F.sort_array(F.collect_list(F.struct("path", "line", "rule", "severity"))).alias("rows"))
    row = lambda x: F.concat(F.lit("| `"), x["path"], F.lit("` | "), x["line"].cast("string"), F.lit(" | `"), x["rule"], F.lit("` | **"), x["severity"], F.lit("** |"))
    head = F.format_string("**%d finding(s)** (%d critical, %d high, %d medium, %d low)", "n", "critical", "high", "medium", "low")
    table = F.concat(head, F.lit("\n\n| File | Line | Rule | Severity |\n|---|---|---|---|\n"), F.array_join(F.transform("rows", row), "\n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n\n_...and "), (F.col("n") - shown).cast("string"), F.lit(" more._"))).otherwise("")
    return n.crossJoin(few).select(F.when(F.col("n") == 0, "**No issues found.**").otherwise(F.concat(table, more)).alias("summary"))


def review_lines(changes: DataFrame) -> DataFrame:
    """A line of text a change of a dependency, as reviews show it."""
    c = F.col
    text = (
        F.when(c("kind") == "Added", F.concat(F.lit("+ "), "name", F.lit(" "), "to_version"))
        .when(c("kind") == "Removed", F.concat(F.lit("- "), "name", F.lit(" "), "from_version"))
        .otherwise(F.concat(F.when(c("kind") == "Upgraded", "^ ").otherwise("v "), "name", F.lit(" "), "from_version", F.lit(" -> "), "to_version"))
    )
    return changes.select("lockfile", "name", "kind", text.alias("line"))


def listing(packages: DataFrame, direct: DataFrame) -> DataFrame:
    """lockfile, at and text of the packages in the order of name and version, with what is required directly."""
    from pyspark.sql import Window

    rows = packages.join(direct.select("lockfile", "name").distinct().withColumn("direct", F.lit(True)), ["lockfile", "name"], "left")
    at = F.row_number().over(Window.partitionBy("lockfile").orderBy("name", "version"))
    return rows.select("lockfile", at.alias("at"), F.concat(F.col("name"), F.lit("@"), F.col("version"), F.when(F.col("direct"), " direct").otherwise("")).alias("text"))


def provenance_rows(commits: DataFrame) -> DataFrame:
    """A JSON object a commit that a tool wrote (hash, tool, lines)."""
    return commits.where("tool is not null").select("hash", F.to_json(F.struct("hash", "tool", "lines")).alias("json"))


def otlp(totals: DataFrame, name: str = "sievework.findings") -> DataFrame:
    """A data point of a gauge by severity, as OTLP's JSON has it."""
    point = F.struct(F.array(F.struct(F.lit("severity").alias("key"), F.struct(F.coalesce("severity", F.lit("all")).alias("stringValue")).alias("value"))).alias("attributes"), F.col("findings").cast("string").alias("asInt"))
    return totals.select(F.coalesce("severity", F.lit("all")).alias("severity"), F.to_json(F.struct(F.lit(name).alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))).alias("metric"))


def prometheus(totals: DataFrame, name: str = "sievework_findings") -> DataFrame:
    """Text lines of a gauge by severity."""
    return totals.select(F.format_string(f'{name}{{severity="%s"}} %d', F.coalesce("severity", F.lit("all")), F.col("findings")).alias("metric"))


def annotation_batches(findings: DataFrame, size: int = 50) -> DataFrame:
    """Findings (path, line, rule) with ``batch``: consecutive ones in the order of path, line and rule, ``size`` a batch but for the last.

    Ranks are a range partition's base plus the place in it, so no one task orders them all; partitions differ from run to run, ranks don't."""
    from pyspark.sql import Window

    order = ["path", "line", "rule"]
    parted = settled(findings.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = parted.withColumn("__place", place).join(bases, "__part")
    return ranked.withColumn("batch", F.ceil((F.col("__base") + F.col("__place")) / size)).drop("__part", "__place", "__base")
