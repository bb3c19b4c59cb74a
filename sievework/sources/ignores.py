"""Which files of a tree its ignore files leave out.

Each folder's ignore file is one row of rules; a path meets the files of the folders above it by equal joins. Folders are judged once each, however many files
they hold, and what lies below an ignored folder is ignored whatever the rules further down say.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import settled, ship

#: Ignore files, the stronger first.
NAMES = (".ignore", ".gitignore")
#: What a single wildcard takes: globs go by bytes, so no sign of several.
ONE = r"[\x00-.0-\x7f]"
#: Rows of one folder that meet in a task.
EACH = 1 << 16
_RULES = "dir string, name string, rules array<struct<regex:string,negated:boolean,folder:boolean>>"


def _class(glob: str, i: int) -> tuple[str, int] | None:
    """A bracket expression that begins at i as a regular expression, and the place after it."""
    j = i + 1
    negated = j < len(glob) and glob[j] in "!^"
    j += negated
    begin = j
    while j < len(glob) and (glob[j] != "]" or j == begin):
        j += 1 + (glob[j] == "\\")
    if j >= len(glob):
        return None
    inside = "".join("\\" + c if c in "[]&^" else c for c in glob[begin:j])
    return f"(?={ONE})[{'^' if negated else ''}{inside}]", j + 1


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex over paths from the ignore file's folder, whether it takes back, whether it only means folders) of a line; None for blank ones and comments."""
    line = line.rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder = line.endswith("/")
    line = line[:-1] if folder else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif line[i] == "*":
            while i < len(line) and line[i] == "*":
                i += 1
            out += "[^/]*"
        elif line[i] == "?":
            out, i = out + ONE, i + 1
        elif line[i] == "[" and (found := _class(line, i)):
            out, i = out + found[0], found[1]
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + (line[i] if line[i].isalnum() or line[i] in "_/ " or ord(line[i]) > 127 else "\\" + line[i]), i + 1
    return f"(?s)^{out}$", negated, folder


def rules(files: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """dir, name and rules, in their order, of the ignore files among files (path, text)."""
    ship(files.sparkSession)
    own = F.element_at(F.split("path", "/"), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sievework.sources.ignores import rule

        for b in batches:
            found = [[dict(zip(("regex", "negated", "folder"), r, strict=True)) for line in (t or "").split("\n") if (r := rule(line))] for t in b["text"]]
            yield pd.DataFrame({"dir": b["dir"], "name": b["name"], "rules": found})

    return files.where(own.isin(*names)).select(_folder(F.col("path")).alias("dir"), own.alias("name"), "text").mapInPandas(run, _RULES)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _above(path: Column) -> Column:
    """The folders above a path, '' for the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _meet(rows: DataFrame, side: DataFrame, how: str = "inner", each: int = EACH) -> DataFrame:
    """rows (path, dir) with the rows of side that have their dir. Paths share the folders near the root, so those with many rows are dealt over parts, and their rows of side copied into each; such folders are one for ``each`` rows at most."""
    wide = F.broadcast(settled(rows.groupBy("dir").agg(F.ceil(F.count("*") / each).cast("int").alias("parts")).where("parts > 1")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(wide, "dir", "left").withColumn("part", F.pmod(F.xxhash64("path"), parts).cast("int")).drop("parts")
    copied = side.join(wide, "dir", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied, ["dir", "part"], how).drop("part")


def _ignored(paths: DataFrame, found: DataFrame, folder: bool, names: tuple[str, ...]) -> DataFrame:
    """The paths whose last rule that takes them ignores them: of the stronger kind of file, then of the deepest folder."""
    asked = _meet(paths.select("path", F.explode(_above(F.col("path"))).alias("dir")), found)
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2))
    takes = lambda r: F.rlike(F.col("rest"), r["regex"]) & (F.lit(folder) | ~r["folder"])
    last = asked.withColumn("rest", rest).withColumn("last", F.try_element_at(F.filter("rules", takes), F.lit(-1))).where("last is not null")
    strength = F.struct(F.array_position(F.array(*map(F.lit, reversed(names))), F.col("name")).alias("kind"), F.length("dir").alias("depth"))
    return last.groupBy("path").agg(F.max_by("last.negated", strength).alias("negated")).where("not negated").select("path")


def walked(files: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """files (path, text) that the tree's own ignore files and its VCS folder leave in; files whose names begin with a dot are files like others."""
    files = files.where(~F.col("path").rlike(r"(?:^|/)\.git(?:/|$)"))
    found, paths = settled(rules(files, names)), settled(files.select("path").distinct())
    below = paths.select("path", F.explode(F.filter(_above(F.col("path")), lambda d: d != "")).alias("dir"))
    shut = _ignored(below.select(F.col("dir").alias("path")).distinct(), found, True, names)
    gone = _meet(below, shut.withColumnRenamed("path", "dir"), "left_semi").select("path").unionByName(_ignored(paths, found, False, names))
    return files.join(gone.distinct(), "path", "left_anti")
