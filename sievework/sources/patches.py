"""Unified diffs and history patches, a patch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.text import line_body


HUNK = re.compile(r"@@[^+]*\+([0-9]+)")
COMMIT = re.compile(r"commit ([0-9a-f]{7,64})([0-9a-f]*)")
#: Rows of a batch on their way out of the helper.
BATCH = 20000


def changed_lines(body: str) -> Iterator[tuple[str | None, str, str, int, str]]:
    """commit, path, kind, line and content of a patch's changed lines."""
    event, commit, path, at = "", None, "", 0
    for c in body.split("\n"):
        if c.startswith("diff --git "):
            event, path = "file", ""
        elif m := COMMIT.match(c):
            event, path, commit = "commit", "", m[1] + m[2]
        elif c.startswith("@@") and (m := HUNK.match(c)):
            event, at = "hunk", int(m[1])
        elif event == "file":
            if c.startswith("+++ "):
                path = c[6:] if c.startswith("+++ b/") else ""
        elif event == "hunk" and path:
            sign = c[:1]
            if sign in ("+", "-"):
                yield commit, path, sign, at, c[1:]
            at += sign not in ("-", "\\")


def diff_lines(patches: DataFrame, key: str = "patch", text: str = "text") -> DataFrame:
    """key, commit, path, kind ('+' or '-'), line in the new file, and content of a patch's changed lines.

    A file's name and a hunk's start carry on to the lines below; a line's number is the hunk's start and the kept or added lines before it. The
    first header line of a hunk ends the headers, so an added line that begins with plus signs is content. A patch is read where it lies: its lines aren't shuffled."""
    ship(patches.sparkSession)
    types = dict(patches.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.sources.patches import BATCH, changed_lines

        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = [key, "commit", "path", "kind", "line", "content"]
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, body in enumerate(b.column(1).to_pylist()):
                n = len(rows)
                rows += changed_lines(body) if body is not None else ()
                at += [i] * (len(rows) - n)
                if rows and (len(rows) >= BATCH or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)
                    at, rows = [], []

    return patches.select(key, line_body(F.col(text)).alias("body")).mapInArrow(run, f"`{key}` {types[key]}, commit string, path string, kind string, line long, content string")


def changed_files(changed: DataFrame, key: str = "patch") -> DataFrame:
    """By file: added and removed lines."""
    return changed.groupBy(key, "path").agg(F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"))


# One entry of name-status output, right behind the one before: renames and copies have two names.
ENTRY = r"\G\x00*(?:[RC][^\x00]*+\x00+[^\x00]++\x00+[^\x00]++|[^RC\x00][^\x00]*+\x00+[^\x00]++)"


def name_status(records: DataFrame, column: str = "raw") -> DataFrame:
    """status, old and path of NUL-separated name-status output; renames and copies have two names. An entry that isn't whole ends the output."""
    entries = records.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(ENTRY), 0)).alias("entry"))
    parts = entries.select(F.filter(F.split("entry", "\0", -1), lambda x: x != "").alias("p"))
    old = F.when(F.size("p") == 3, F.col("p")[1])
    return parts.select(F.substring(F.col("p")[0], 1, 1).alias("status"), old.alias("old"), F.element_at("p", -1).alias("path"))
