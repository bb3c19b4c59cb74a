"""Coverage, complexity, provenance, affected tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the complexity score and its tiers.
ADDED, FILES, NODES, REMOVED = 0.3, 5.0, 2.0, 0.1
TIERS = ((20, "Quick Review"), (50, "Normal Review"), (100, "Complex Review"))
LARGEST = "Large PR — consider splitting"
# Tools by what commits name them.
TOOLS = (("claude", "Claude"), ("copilot", "GitHub Copilot"), ("cursor", "Cursor"), ("aider", "Aider"), ("devin", "Devin"), ("codex", "Codex"), ("gemini", "Gemini"))


def percent(hit: Column, found: Column) -> Column:
    return F.coalesce(100.0 * hit / F.nullif(found, F.lit(0)), F.lit(100.0))


def coverage_gate(records: DataFrame, least: float) -> DataFrame:
    """One row: the total gates; the number of files below it explains."""
    files = records.groupBy("path").agg(F.sum("hit").alias("hit"), F.sum("found").alias("found"))
    out = files.agg(F.sum("hit").alias("hit"), F.sum("found").alias("found"), F.count_if(percent(F.col("hit"), F.col("found")) < least).alias("files_below"))
    return out.select("hit", "found", F.round(percent(F.col("hit"), F.col("found")), 6).alias("percent"), "files_below", (percent(F.col("hit"), F.col("found")) >= least).alias("passed"))


def new_code_coverage(added: DataFrame, hits: DataFrame) -> DataFrame:
    """By file: added lines that are covered, uncovered and unmeasured, and the share of the measured that is covered."""
    rows = added.join(hits, ["path", "line"], "left")
    out = rows.groupBy("path").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count_if(F.col("hits") == 0).alias("uncovered"), F.count_if(F.col("hits").isNull()).alias("unmeasured"))
    return out.withColumn("percent", F.round(percent(F.col("covered"), F.col("covered") + F.col("uncovered")), 6))


def new_code_gate(by_file: DataFrame, least: float) -> DataFrame:
    """One row over all files: the counts, the share of measured added lines that is covered (100 where none is measured), and whether it passes; files only explain."""
    sums = by_file.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("covered", "uncovered", "unmeasured")))
    share = F.round(percent(F.col("covered"), F.col("covered") + F.col("uncovered")), 6)
    return sums.withColumn("percent", share).withColumn("passed", F.col("percent") >= least)


def _endings(path: Column) -> Column:
    """Every ending of a path that holds its whole last part."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.transform(F.sequence(F.lit(1), F.length(path) - F.length(last) + 1), lambda i: F.substr(path, i))


def coverage_file(paths: DataFrame, covered: DataFrame) -> DataFrame:
    """For each changed path the coverage file that is it, or ends with it, or which it ends with: exact first, then the longest, then by name.

    A path meets its equals among the files' endings, of which each has its best file, and its own endings meet the files: equi joins whose keys are single on one side, however many paths share a last part."""
    files, changed = covered.select(F.col("path").alias("file")).distinct(), paths.select("path").distinct()
    rank = lambda key: F.struct((F.col("file") != F.col(key)).alias("other"), (-F.length("file")).alias("shorter"), F.col("file"))
    best = files.select("file", F.explode(_endings(F.col("file"))).alias("path")).groupBy("path").agg(F.min(rank("path")).alias("best"))
    whole = changed.join(best, "path")
    own = changed.select("path", F.explode(_endings(F.col("path"))).alias("file")).join(files, "file").select("path", rank("path").alias("best"))
    return whole.unionByName(own).groupBy("path").agg(F.min("best").alias("best")).select("path", "best.file")


def complexity(changes: DataFrame) -> DataFrame:
    """Score, minutes and tier of changes with files, added, removed and nodes."""
    raw = F.col("added") * ADDED + F.col("files") * FILES + F.col("nodes") * NODES + F.col("removed") * REMOVED
    score = F.round(raw).cast("long")
    tier = F.lit(LARGEST)
    for most, name in reversed(TIERS):
        tier = F.when(score <= most, name).otherwise(tier)
    return changes.withColumn("score", score).withColumn("minutes", F.floor(F.least(raw * 0.5, F.lit(120.0)))).withColumn("tier", tier)


def ai_tool(name: Column, email: Column, message: Column) -> Column:
    """The tool a commit names: in its trailers, else by two phrases that tools insert, else by its author; the first tool in the list's order."""
    trailers = F.filter(F.transform(F.split(message, "\r?\n", -1), lambda x: F.lower(F.trim(x))), lambda x: x.startswith("co-authored-by:") | x.startswith("assisted-by:"))
    values = F.transform(trailers, lambda x: F.regexp_replace(x, "^(co-authored-by:|assisted-by:)", ""))
    of = lambda text: F.coalesce(*(F.when(text.contains(n), d) for n, d in TOOLS))
    first = F.get(F.filter(F.transform(values, of), lambda x: x.isNotNull()), F.lit(0))
    low = F.lower(message)
    phrase = F.when(low.contains("generated with claude") | low.contains("🤖 generated with"), "Claude")
    return F.coalesce(first, phrase, of(F.lower(F.concat_ws("\n", name, email))))


def ai_share(commits: DataFrame) -> DataFrame:
    """One row: added lines by tools and in all, and the rounded share."""
    out = commits.agg(F.coalesce(F.sum(F.when(F.col("tool").isNotNull(), F.col("added"))), F.lit(0)).alias("tool_lines"), F.coalesce(F.sum("added"), F.lit(0)).alias("lines"))
    return out.withColumn("percent", F.round(F.coalesce(100.0 * F.col("tool_lines") / F.nullif("lines", F.lit(0)), F.lit(0.0))).cast("long"))


def stems(path: Column) -> Column:
    """The path without its extension, as every suffix of whole parts: a/b/c, b/c, c."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def affected_tests(tests: DataFrame, changed: DataFrame) -> DataFrame:
    """Tests that import a changed file: an import equals or ends with its stem, or names its folder. Equi joins on exploded suffixes."""
    whole = changed.select(F.explode(stems(F.col("path"))).alias("stem")).distinct()
    folder = changed.select(F.explode(stems(F.regexp_replace("path", "/[^/]+$", ""))).alias("stem")).where("stem <> ''").distinct()
    imports = tests.withColumn("stem", F.regexp_replace(F.regexp_replace("import", r"^[./]+", ""), r"\.(js|ts|tsx|jsx|py|go|rs)$", ""))
    return imports.join(whole.unionByName(folder).distinct(), "stem", "left_semi").select("test").distinct()
