"""What lies in a tree: files by glob, changes between two states of it, installed packages, plans of installs, and where a lockfile names an entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import normal_name
from ..operators.suppress import glob_regex

#: Lines after its name in which an entry's version may stand.
NEAR = 5
_PLAN = (
    "struct<install:array<struct<metadata:struct<name:string,version:string>,requested:boolean,"
    "download_info:struct<url:string,archive_info:struct<hash:string,hashes:struct<sha256:string>>,dir_info:struct<editable:boolean>,vcs_info:struct<vcs:string>>>>>"
)


def matching(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files whose path any of the globs takes, such as test files."""
    return files.where(reduce(lambda a, b: a | b, [F.col("path").rlike(glob_regex(g)) for g in globs], F.lit(False)))


def workflows(files: DataFrame) -> DataFrame:
    """CI workflow files with ``at``, their place by name."""
    found = matching(files, [".github/workflows/*.yml", ".github/workflows/*.yaml"])
    # A repository has a few workflows, whatever its size.
    return found.withColumn("at", F.row_number().over(Window.orderBy("path")))


def changed(head: DataFrame, base: DataFrame) -> DataFrame:
    """path, status (added, deleted, modified) and both texts, between two snapshots (path, text)."""
    both = head.select("path", F.col("text").alias("text"), F.lit(True).alias("here")).join(base.select("path", F.col("text").alias("base_text"), F.lit(True).alias("there")), "path", "full_outer")
    status = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~F.col("text").eqNullSafe(F.col("base_text")), "modified")
    return both.withColumn("status", status).where("status is not null").select("path", "status", "text", "base_text")


def installed(files: DataFrame) -> DataFrame:
    """name, version, scripts, native and depth of the packages whose manifests (path, text) lie under node_modules, nested ones too; a name may have a scope. A manifest that can't be read has neither version nor scripts."""
    shape = r"^(?:.*/)?node_modules/((?:@[^/]+/)?[^/@][^/]*)/package\.json$"
    rows = files.where(F.col("path").rlike(shape) & ~F.col("path").rlike(r"node_modules/\.[^/]*/package\.json$"))
    read = F.from_json("text", "version string, scripts map<string,string>, gypfile boolean")
    rows = rows.withColumns({"m": read, "name": F.regexp_extract("path", shape, 1)})
    depth = F.size(F.split("path", "(?:^|/)node_modules/")) - 1
    return rows.select("path", "name", F.col("m.version").alias("version"), F.col("m.scripts").alias("scripts"), F.coalesce("m.gypfile", F.lit(False)).alias("native"), depth.alias("depth"))


def pip_plan(files: DataFrame, text: str = "text") -> DataFrame:
    """name, version, kind (wheel, sdist, source), url, sha256 and requested of the items of pip's install reports."""
    keep = [c for c in files.columns if c != text]
    rows = files.select(*keep, F.explode(F.from_json(text, _PLAN)["install"]).alias("i"))
    info = F.col("i.download_info")
    path = F.regexp_replace(info["url"], "[?#].*$", "")
    kind = F.when(info["dir_info"].isNotNull() | info["vcs_info"].isNotNull(), "source").when(F.lower(path).endswith(".whl"), "wheel").otherwise("sdist")
    old = F.regexp_extract(info["archive_info"]["hash"], "^sha256=(.+)$", 1)
    digest = F.coalesce(info["archive_info"]["hashes"]["sha256"], F.when(old != "", old))
    return rows.select(*keep, normal_name(F.lit("PyPI"), F.col("i.metadata.name")).alias("name"), F.col("i.metadata.version").alias("version"), kind.alias("kind"), info["url"].alias("url"), digest.alias("sha256"), F.coalesce("i.requested", F.lit(False)).alias("requested"))


def entry_lines(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (path, name, version) with ``line``: the first that holds the name as a word of its own and the version there or within the next lines; null where none does.

    Names meet the words of the lines by an equal join."""
    order = Window.partitionBy("path").orderBy("line")
    near = F.concat_ws("\n", *(F.lead("content", i).over(order) if i else F.col("content") for i in range(NEAR + 1)))
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z0-9@][A-Za-z0-9._/-]*)")))
    shown = lines.select("path", "line", "content", near.alias("near")).select("path", "line", "near", F.explode(words).alias("name"))
    found = shown.join(entries, ["path", "name"]).where(F.contains("near", "version")).groupBy("path", "name", "version").agg(F.min("line").alias("line"))
    return entries.join(found, ["path", "name", "version"], "left")
