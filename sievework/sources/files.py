"""Working trees and archives as relations of files."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.suppress import glob_regex

HEAD = 8192
#: Members of image layers that are larger aren't scanned.
LARGEST = 1 << 20


def tree(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """path (relative), content (binary) and length of the files under a root, without excluded globs and the VCS folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr("path", root.rstrip("/") + "/")
    relative = F.when(at > 0, F.substr("path", at + F.lit(len(root.rstrip("/")) + 1))).otherwise(F.col("path"))
    return files.select(relative.alias("path"), "content", "length").where(~excluded(F.col("path"), [".git/**", *(excludes or [])]))


def excluded(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def binary(content: Column) -> Column:
    """A NUL among the first bytes of what isn't UTF-8."""
    return ~F.is_valid_utf8(content.cast("string")) & (F.position(F.lit(b"\0"), F.substring(content, 1, HEAD)) > 0)


def texts(files: DataFrame) -> DataFrame:
    """path and text of the files that aren't binary; bad bytes become U+FFFD."""
    return files.where(~binary(F.col("content"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def selected(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Only the files that a diff names."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def _members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir() and i.file_size <= LARGEST:
                    yield i.filename, z.read(i)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                parts = m.name.split("/")
                # No links, no whiteouts, nothing outside.
                if m.isfile() and m.size <= LARGEST and ".." not in parts and not parts[-1].startswith(".wh."):
                    yield m.name.removeprefix("./"), t.extractfile(m).read()
    except tarfile.TarError:
        return


def members(archives: DataFrame) -> DataFrame:
    """archive, path and content of the files in zip and tar archives (path, content); what is no archive has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sievework.sources.files import _members

        for b in batches:
            rows = [(p, n, d) for p, c in zip(b["path"], b["content"], strict=True) if c is not None for n, d in _members(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary")
