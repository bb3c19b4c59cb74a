"""Coverage reports as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_body


def kind(path: Column, text: Column) -> Column:
    """'lcov' or 'cobertura', by the name, else by what the text begins with."""
    head = F.substring(text, 1, 256)
    return F.when(path.endswith(".xml"), "cobertura").when(path.endswith(".info") | path.endswith(".lcov"), "lcov").when(head.contains("<?xml") | head.contains("<coverage"), "cobertura").when(head.contains("SF:") | head.contains("TN:"), "lcov")


def _records(reports: DataFrame, key: str) -> DataFrame:
    """key and record, the lines of each file's record; lines before the first are none's. A report is read where it lies: its lines aren't shuffled."""
    records = F.filter(F.split(line_body(F.col("text")), r"\n(?=SF:)", -1), lambda r: r.startswith("SF:"))
    return reports.select(key, F.explode(records).alias("record")).select(key, F.split("record", "\n", -1).alias("record"))


def lcov_totals(reports: DataFrame, key: str = "report") -> DataFrame:
    """key, path, hit and found of each record that ends; reports are key and text."""
    number = lambda tag: F.coalesce(F.trim(F.substr(F.try_element_at(F.filter("record", lambda x: x.startswith(tag)), F.lit(-1)), F.lit(4))).try_cast("long"), F.lit(0))
    ended = _records(reports, key).where(F.array_contains("record", "end_of_record"))
    return ended.select(key, F.substr(F.col("record")[0], F.lit(4)).alias("path"), number("LH:").alias("hit"), number("LF:").alias("found"))


def lcov_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    """key, path, line and hits; of a line's repeated entries in a report the last counts. A report is one row."""
    records = F.filter(F.split(line_body(F.col("text")), r"\n(?=SF:)", -1), lambda r: r.startswith("SF:"))
    parts = lambda x: F.split(F.substr(x, F.lit(4)), ",")
    entry = lambda path, x: F.struct(path.alias("path"), F.get(parts(x), F.lit(0)).try_cast("int").alias("line"), F.get(parts(x), F.lit(1)).try_cast("long").alias("hits"))
    of = lambda r: F.transform(F.filter(F.split(r, "\n", -1), lambda x: x.startswith("DA:")), lambda x: entry(F.substr(F.substring_index(r, "\n", 1), F.lit(4)), x))
    entries = F.filter(F.flatten(F.transform(records, of)), lambda e: e["line"].isNotNull() & e["hits"].isNotNull())
    placed = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["path"].alias("path"), e["line"].alias("line"), i.alias("i"), e["hits"].alias("hits"))))
    rows = reports.select(key, placed.alias("e"))
    # Entries of one line stand together, in order: the one before another line's is the last.
    last = F.zip_with("e", F.slice("e", F.lit(2), F.size("e")), lambda a, b: F.when(b.isNull() | (a["path"] != b["path"]) | (a["line"] != b["line"]), a))
    return rows.where(F.size("e") > 0).select(key, F.inline(F.filter(last, lambda x: x.isNotNull()))).drop("i")


COBERTURA = "_filename string, lines struct<line: array<struct<_number: int, _hits: long>>>, methods struct<method: array<struct<lines: struct<line: array<struct<_number: int, _hits: long>>>>>>"


def cobertura_classes(reports: DataFrame, key: str = "report") -> DataFrame:
    """key, path and every line entry, of methods too, of Cobertura XML; reports are key and text."""
    # One class element at a time, so the depth of packages doesn't matter.
    classes = reports.select(key, F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<class\b.*?</class>)"))).alias("xml"))
    parsed = classes.select(key, F.from_xml("xml", COBERTURA).alias("c"))
    none = F.array().cast("array<struct<_number:int,_hits:bigint>>")
    inner = F.flatten(F.transform(F.coalesce("c.methods.method", F.array().cast("array<struct<lines:struct<line:array<struct<_number:int,_hits:bigint>>>>>")), lambda m: F.coalesce(m["lines"]["line"], none)))
    return parsed.select(key, F.coalesce("c._filename", F.lit("")).alias("path"), F.concat(inner, F.coalesce("c.lines.line", none)).alias("entries"))


def cobertura_totals(reports: DataFrame, key: str = "report") -> DataFrame:
    """hit and found by class; entries of methods count again, as the format repeats them."""
    rows = cobertura_classes(reports, key).where(F.size("entries") > 0)
    return rows.select(key, "path", F.size(F.filter("entries", lambda e: e["_hits"] > 0)).cast("long").alias("hit"), F.size("entries").cast("long").alias("found"))


def cobertura_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    rows = cobertura_classes(reports, key).select(key, "path", F.posexplode("entries").alias("at", "e"))
    return rows.groupBy(key, "path", F.col("e._number").alias("line")).agg(F.max_by(F.coalesce("e._hits", F.lit(0)), "at").alias("hits"))
