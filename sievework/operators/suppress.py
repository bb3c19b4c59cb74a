"""Suppression: exceptions, what a base revision has already, and baselines, each on what the former left open."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import settled, ship
from ..functions.fingerprint import normal_path


def occurrences(findings: DataFrame) -> DataFrame:
    """Number identical (rule, path, match) from the top, from 0."""
    return findings.withColumn("occurrence", F.row_number().over(Window.partitionBy("rule", "path", "match").orderBy("line")) - 1)


def exact(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """findings with ``known``: one-to-one by fingerprint, as bags."""
    number = lambda df, order: df.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    left = number(findings, ["path", "line"])
    right = number(baseline.select(key), [key]).select(key, "copy", F.lit(True).alias("known"))
    return left.join(right, [key, "copy"], "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("copy")


def moved(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that alone have their (rule, match), as alone does a baseline entry: the same one, elsewhere."""
    alone = lambda df: df.where("match <> ''").withColumn("n", F.count("*").over(Window.partitionBy("rule", "match"))).where("n = 1").drop("n")
    base = alone(baseline).select("rule", "match", F.col("path").alias("old_path"), F.col("line").alias("old_line"))
    return alone(findings).join(base, ["rule", "match"])


def _nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Each finding in turn claims the free entry nearest by line, then by occurrence; of the free ones, which are sorted, only those next to it can be."""
    free = sorted(zip(right["line"], right["occurrence"], strict=True))
    left = left.sort_values(["line", "occurrence"])
    claimed: list[int | None] = []
    for line, occurrence in zip(left["line"], left["occurrence"], strict=True):
        at = bisect_left(free, (line,))
        best = None
        for near in {free[i][0] for i in (at - 1, at) if 0 <= i < len(free)}:
            on = bisect_left(free, (near, occurrence))
            for i in (on - 1, on):
                if 0 <= i < len(free) and free[i][0] == near:
                    key = (abs(near - line), abs(free[i][1] - occurrence), bisect_left(free, free[i]))
                    best = key if best is None else min(best, key)
        claimed.append(free.pop(best[2])[0] if best else None)
    return left[["rule", "path", "match", "line", "occurrence"]].assign(base_line=pd.array(claimed, dtype="Int64"))


def shifted(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Same rule, path and match, greedily nearest, each entry claimed once. A group is one rule's equal matches in one file."""
    ship(findings.sparkSession)
    keys, cols = ["rule", "path", "match"], ["rule", "path", "match", "line", "occurrence"]
    left, right = (df.select(*cols).groupBy(*keys) for df in (findings, baseline))
    return left.cogroup(right).applyInPandas(_nearest, "rule string, path string, match string, line long, occurrence long, base_line long")


def legacy(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, suppressed) by exact path, rule and line."""
    keys = ["path", "rule", "line"]
    return findings.join(baseline, keys, "left_anti"), findings.join(baseline, keys, "left_semi")


def new_since(head: DataFrame, base: DataFrame) -> DataFrame:
    """Findings of head beyond those of base, as bags."""
    return head.exceptAll(base)


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ** crosses folders, * and ? don't."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def exceptions(findings: DataFrame, rules: list[dict], today: Column) -> DataFrame:
    """findings with the first exception in file order that matches, and whether it has expired; an expired one doesn't suppress.

    rules: dicts of id, reason, owner, expires (ISO date), and any of rule, path (glob), fingerprint, package. They are a few
    lines of a file, so they become expressions, not a join."""
    first = F.lit(None).cast("struct<id:string,expires:date,owner:string>")
    for r in reversed(rules):
        tests = [F.col(k) == r[k] for k in ("rule", "fingerprint", "package") if k in r] + ([F.col("path").rlike(glob_regex(r["path"]))] if "path" in r else [])
        both = tests[0]
        for t in tests[1:]:
            both = both & t
        first = F.when(both, F.struct(F.lit(r["id"]).alias("id"), F.lit(r["expires"]).cast("date").alias("expires"), F.lit(r.get("owner", "")).alias("owner"))).otherwise(first)
    out = findings.withColumn("__e", first)
    expired = today > F.col("__e.expires")
    return out.select(
        *findings.columns,
        F.col("__e.id").alias("exception"),
        F.coalesce(expired, F.lit(False)).alias("expired"),
        (F.col("__e.id").isNotNull() & ~F.coalesce(expired, F.lit(False))).alias("suppressed"),
        F.datediff(F.col("__e.expires"), today).alias("days_left"),
    )


def expiring(judged: DataFrame, within: int = 14) -> DataFrame:
    """One warning for each exception in use that ends within the days."""
    return judged.where(F.col("suppressed") & (F.col("days_left") < within)).select("exception", "days_left").distinct()


def unclaimed(baseline: DataFrame, findings: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Baseline entries that no finding claims, as bags."""
    return baseline.select(key).exceptAll(findings.select(key))


def subject(findings: DataFrame) -> DataFrame:
    """findings with ``subject`` (path, line, match): what a finding is about, by ``kind``. A package is known by its name, whatever its version; an address or a project has no line."""
    c = F.col
    file, lined = c("kind") == "file", (c("kind") == "file") & c("line").isNotNull()
    path = F.when(file | (c("kind") == "package"), F.coalesce(normal_path(c("path")), F.lit(""))).when(c("kind") == "url", c("url")).otherwise("")
    match = F.when(lined, c("value")).when(c("kind") == "package", F.concat_ws(":", "ecosystem", "name")).otherwise("")
    return findings.withColumn("subject", F.struct(path.alias("path"), F.when(lined, c("line")).otherwise(0).cast("bigint").alias("line"), match.alias("match")))


_KEYED = ("rule", "path", "match", "line", "occurrence", "fingerprint")


def known(findings: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with ``how``: exact, shifted, moved or null, and ``moved_from``; entries that none claimed). Both sides hold rule, path, match, line, occurrence and fingerprint.

    Each entry is claimed once: by an equal fingerprint, then by the nearest line in its group of equal rule, path and match, then where
    one finding and one entry alone are left of a rule and match. Findings go one by one only in groups that both sides still have."""
    number = lambda df: df.withColumn("copy", F.row_number().over(Window.partitionBy("fingerprint").orderBy("path", "line", "occurrence")))
    left = settled(number(findings))
    right = settled(number(entries.select(*(F.col(c).alias(c) for c in _KEYED))))
    claims = ["fingerprint", "copy"]
    exactly = left.join(right.select(*claims), claims, "left_semi").drop("copy").withColumns({"how": F.lit("exact"), "moved_from": F.lit(None).cast("string")})
    left, right = left.join(right.select(*claims), claims, "left_anti").drop("copy"), right.join(left.select(*claims), claims, "left_anti").drop("copy")
    left, right = settled(left), settled(right)
    got = settled(shifted(left, right).where("base_line is not null").select("rule", "path", "match", "line", "occurrence", "base_line"))
    keys = ["rule", "path", "match", "line", "occurrence"]
    shift = left.join(got.select(*keys), keys, "left_semi").withColumns({"how": F.lit("shifted"), "moved_from": F.lit(None).cast("string")})
    left = left.join(got.select(*keys), keys, "left_anti")
    # An entry is gone as often as its group and line were claimed.
    at = ["rule", "path", "match", "line"]
    taken = got.groupBy("rule", "path", "match", F.col("base_line").alias("line")).agg(F.count("*").alias("taken"))
    nth = F.row_number().over(Window.partitionBy(*at).orderBy("occurrence", "fingerprint"))
    right = right.withColumn("nth", nth).join(taken, at, "left").where(F.col("nth") > F.coalesce("taken", F.lit(0))).drop("nth", "taken")
    left, right = settled(left), settled(right)
    one = lambda df: df.where("match <> ''").groupBy("rule", "match").agg(F.count("*").alias("n"), F.min("path").alias("from")).where("n = 1")
    both = one(left).select("rule", "match").join(one(right).select("rule", "match", "from"), ["rule", "match"])
    rest = left.join(both, ["rule", "match"], "left").withColumns({"how": F.when(F.col("from").isNotNull(), "moved"), "moved_from": F.col("from")}).drop("from")
    free = right.join(both.select("rule", "match"), ["rule", "match"], "left_anti")
    columns = [*findings.columns, "how", "moved_from"]
    return exactly.select(*columns).unionByName(shift.select(*columns)).unionByName(rest.select(*columns)), free


def suppression_pass(findings: DataFrame, rules: list[dict], today: Column, base: DataFrame | None = None, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(findings with ``verdict``: exception, base, baseline or null, and ``detail``; baseline entries that none claimed). Each stage sees only what the former left open; an expired exception leaves a finding open and says so."""
    judged = exceptions(findings, rules, today)
    judged = judged.withColumns({"verdict": F.when(F.col("suppressed"), "exception"), "detail": F.when(F.col("suppressed"), F.col("exception")).when(F.col("expired"), F.concat(F.col("exception"), F.lit(" expired")))})
    judged = judged.drop("exception", "expired", "suppressed", "days_left")
    done, open_, free = judged.where("verdict is not null"), judged.where("verdict is null"), None
    for name, entries in (("base", base), ("baseline", baseline)):
        if entries is None:
            continue
        found, free = known(open_, entries)
        found = settled(found)
        detail = F.when(F.col("how").isNotNull(), F.concat_ws(" from ", "how", "moved_from")).otherwise(F.col("detail"))
        found = found.withColumns({"verdict": F.when(F.col("how").isNotNull(), name), "detail": detail}).drop("how", "moved_from")
        done, open_ = done.unionByName(found.where("verdict is not null")), found.where("verdict is null")
    return done.unionByName(open_), free


BASELINE_V1 = "array<struct<path:string,rule_id:string,line:bigint>>"
BASELINE_V2 = "struct<version:int,salt:string,generator:string,entries:array<struct<tool:string,fingerprint:string,match:string,rule_id:string,path:string,line_hint:bigint,occurrence:bigint>>>"


def read_baseline(files: DataFrame, text: str = "text") -> DataFrame:
    """One row an entry of baseline files: version (1: a bare list; 2: an object), tool, rule, path, line, fingerprint, match and occurrence. A file that can't be read has one row with version null."""
    t = F.regexp_replace(text, r"^\s+", "")
    old = F.when(t.startswith("["), F.from_json(t, BASELINE_V1, {"mode": "PERMISSIVE"}))
    new = F.when(~t.startswith("["), F.from_json(t, BASELINE_V2, {"mode": "PERMISSIVE"}))
    entry = lambda v, e: F.struct(F.lit(v).alias("version"), *((e[f].cast(k) if f else F.lit(None).cast(k)).alias(n) for n, f, k in _ENTRY[v]))
    none = F.array(F.struct(F.lit(None).cast("int").alias("version"), *(F.lit(None).cast(k).alias(n) for n, _, k in _ENTRY[2])))
    rows = F.when(old.isNotNull(), F.transform(old, lambda e: entry(1, e))).when(new["version"] == 2, F.transform(new["entries"], lambda e: entry(2, e))).otherwise(none)
    return files.select(*[c for c in files.columns if c != text], F.inline(rows)).withColumn("entry_path", normal_path(F.col("entry_path")))


_ENTRY = {
    1: [("tool", None, "string"), ("rule", "rule_id", "string"), ("entry_path", "path", "string"), ("line", "line", "bigint"), ("fingerprint", None, "string"), ("match", None, "string"), ("occurrence", None, "bigint")],
    2: [("tool", "tool", "string"), ("rule", "rule_id", "string"), ("entry_path", "path", "string"), ("line", "line_hint", "bigint"), ("fingerprint", "fingerprint", "string"), ("match", "match", "string"), ("occurrence", "occurrence", "bigint")],
}


def updated_baseline(entries: DataFrame, findings: DataFrame, tool: str) -> DataFrame:
    """A baseline's entries with those of one tool replaced by its findings; ``at`` is their place in the file: by tool, path, line and rule."""
    columns = ["tool", "fingerprint", "match", "rule", "path", "line", "occurrence"]
    own = findings.withColumn("tool", F.lit(tool)).select(*columns)
    every = entries.where(F.col("tool") != tool).select(*columns).unionByName(own)
    return every.withColumn("at", F.row_number().over(Window.partitionBy("tool").orderBy("path", "line", "rule", "fingerprint", "occurrence")))


def migrated(old: DataFrame, findings: DataFrame, tool: str) -> DataFrame:
    """Version 1 entries as version 2: those that a present finding has at the same path, rule and line, with its fingerprint; entries without one are dropped."""
    keys = ["path", "rule", "line"]
    return findings.join(old.select(*keys).distinct(), keys, "left_semi").select(F.lit(tool).alias("tool"), "fingerprint", "match", "rule", "path", "line", "occurrence")


def exceptions_from_ignores(ids: DataFrame, rules: list[dict], owner: str, expires: str) -> DataFrame:
    """An exception for each ignored advisory id that none of the rules names yet."""
    named = [r["id"].upper() for r in rules] + [r["rule"].removeprefix("OSV/").upper() for r in rules if "rule" in r]
    new = ids.select(F.upper("ignored_id").alias("id")).distinct()
    new = new.where(~F.col("id").isin(*named)) if named else new
    return new.select("id", F.concat(F.lit("OSV/"), "id").alias("rule"), F.lit("migrated from the ignore list").alias("reason"), F.lit(owner).alias("owner"), F.lit(expires).cast("date").alias("expires"))


def triaged(findings: DataFrame, answers: DataFrame, threshold: float) -> DataFrame:
    """findings with verdict, confidence and ``suppressed``, from a reviewer's answers (id, text): the JSON object between the first and the last brace.
    Only a false positive of enough confidence is suppressed, and nothing at a threshold of 0; what can't be read is uncertain."""
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    read = F.from_json(body, "verdict string, confidence double, reason string")
    rows = answers.select("id", read.alias("r"))
    verdict = F.when(F.col("r.verdict").isin("real", "false_positive"), F.col("r.verdict")).otherwise("uncertain")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.5))))
    rows = rows.select("id", verdict.alias("verdict"), F.when(F.col("r").isNull(), 0.5).otherwise(sure).alias("confidence"))
    out = findings.join(rows, "id", "left")
    return out.withColumn("suppressed", F.coalesce(F.lit(threshold > 0) & (F.col("verdict") == "false_positive") & (F.col("confidence") >= threshold), F.lit(False)))
