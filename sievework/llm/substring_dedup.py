"""Substring dedup of word windows with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. A first pass sketches how often the windows' keys
occur: windows are counted by runs that share their smallest 4-word gram (see ``runs``), so a
count is never less than that of any window in it. The tasks' sketches are merged by part. A second pass keeps
only windows that the sketch counts twice or more, which loses none that repeats, and groups them exactly:
first whole runs by a 128-bit digest of their words, then, where runs with one gram differ, their single windows by a
digest of theirs. A window is removed from a document if it also stands in one with a smaller doc_id.

Scale: the sketch grows with the corpus up to 32 MB a row in the driver and in each worker; when a corpus fills it, more
windows pass and the exact grouping has more rows, but none is lost. Grouping is by aggregation with partial sums,
and by joins of plain tables, which adaptive execution splits where a passage is very common. Texts are
shuffled twice, once for the windows of differing runs and once for the result.

Defined cases: null text has no words; documents with fewer words than a window lose nothing; rows with
one doc_id don't remove each other's words; null doc_id counts as the largest; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, keyed, materialize, ship, span_digests, span_hashes, squeezed, tidy
from .runs import Packed, cells_for, maybe_repeated, repeated_cells, sketched, window_runs

WINDOW, GRAM = 13, 4
BLOCK = 1 << 20
#: Bytes of text for each cell of the sketch: about four cells a run.
CELL_TEXT = 8
REFS = "doc bigint, tag bigint, v bigint, d1 bigint, d2 bigint, start int, n int"


def _runs(column: pa.Array, window: int) -> Iterator[tuple]:
    """Of blocks of rows: their number in the column, the words' bytes, starts and ends, the first word of each run's row, and the runs' rows, first windows, numbers of windows and grams."""
    gram = min(GRAM, window)
    for a, _, buf, offsets in chunks(column, BLOCK):
        text, starts, ends, words = squeezed(buf, offsets)
        grams = gram_hashes(span_hashes(text, starts, ends), gram) if len(starts) else np.zeros(0, np.uint64)
        row, first, n, v = window_runs(grams, words, window, gram)
        yield a, text, starts, ends, words[row], row, first, n, v


def sketch(docs: DataFrame, window: int) -> Packed:
    """Bits of the keys that occur twice or more, by count-min over all runs."""
    count = cells_for(docs, CELL_TEXT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketched((r[-1] for batch in batches for r in _runs(batch.column(0), window)), count)

    return repeated_cells(docs.select("text").mapInArrow(tidy(scan), "shard int, cells binary"), count)


def repeated_runs(docs: DataFrame, window: int) -> DataFrame:
    """The runs that the sketch counts twice or more, with digests of their words."""
    bits = sketch(docs, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, text, starts, ends, base, row, first, n, v in _runs(batch.column(2), window):
                ok = np.flatnonzero(maybe_repeated(v, bits))
                first, n = first[ok], n[ok]
                d = span_digests(text, starts[first], ends[first + n + window - 2])
                at = pa.array(row[ok] + a)
                columns = [pa.array(v[ok].view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(first - base[ok], pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc", "tag", "v", "d1", "d2", "start", "n"])

    return materialize(docs.select("doc", "tag", "text").mapInArrow(tidy(scan), REFS), "runs")


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of the listed runs with a digest of its words."""
    for batch in batches:
        lists = batch.column(3)
        spans = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        start, n = (spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for a, b, buf, offsets in chunks(batch.column(2), BLOCK):
            text, starts, ends, words = squeezed(buf, offsets)
            own = slice(bounds[a], bounds[b])
            row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            row, first = np.repeat(row, n[own]), np.repeat(start[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(int(n[own].sum()))
            at = words[row] + first
            d = span_digests(text, starts[at], ends[at + window - 1])
            keys = pa.array(row + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keys), batch.column(1).take(keys), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(first, pa.int32())], names=["doc", "tag", "w1", "w2", "start"])


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, and first word and number of words of spans to remove; spans may overlap."""
    refs = repeated_runs(docs, window)
    least = materialize(refs.groupBy("v", "d1", "d2").agg(F.min("doc").alias("least")), "first-runs")
    # A gram whose runs differ: their windows have to be looked at one by one.
    mixed = materialize(least.groupBy("v").agg(F.count("*").alias("kinds")).where("kinds > 1").select("v"), "mixed")
    kinds = materialize(least.join(mixed.withColumn("mixed", F.lit(True)), "v", "left").select("d1", "d2", "least", F.coalesce("mixed", F.lit(False)).alias("mixed")), "kinds")
    judged = materialize(
        refs.join(kinds, ["d1", "d2"]).where("doc > least or mixed").select("doc", "tag", "start", "n", (F.col("doc") > F.col("least")).alias("whole")), "judged"
    )
    # What repeats a run of a smaller document goes whole; of mixed runs, each one's first document speaks for it.
    first = judged.where("not whole").groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    texts = docs.select("doc", "tag", "text").dropDuplicates(["doc", "tag"])
    asked = texts.join(first, ["doc", "tag"]).select("doc", "tag", "text", "spans")
    windows = materialize(asked.mapInArrow(tidy(_windows, window), "doc bigint, tag bigint, w1 bigint, w2 bigint, start int"), "windows")
    earliest = materialize(windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").select("w1", "w2", "least"), "windows-first")
    single = windows.join(earliest, ["w1", "w2"]).where("doc > least").select("doc", "tag", "start", F.lit(window).alias("length"))
    return judged.where("whole").select("doc", "tag", "start", (F.col("n") + window - 1).alias("length")).unionByName(single)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        spans = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        start, length = (spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for a, b, buf, offsets in chunks(batch.column(1), BLOCK):
            text, starts, ends, words = squeezed(buf, offsets)
            own = slice(bounds[a], bounds[b])
            base = words[:-1][np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))]
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, base + start[own], 1)
            np.add.at(edge, base + start[own] + length[own], -1)
            gone = np.cumsum(edge[:-1]) > 0
            # A removed word goes with the space after it.
            keep = np.repeat(~gone, ends - starts + 1)
            left = np.concatenate([[0], np.cumsum(np.where(gone, 0, ends - starts + 1))])
            data = text[keep].tobytes()
            texts = [data[x : max(x, y - 1)] for x, y in zip(left[words[:-1]].tolist(), left[words[1:]].tolist(), strict=True)]
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(words)), pa.array(removed[words[1:]] - removed[words[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def dedup_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row."""
    ship(docs.sparkSession)
    own = keyed(docs)
    spans = removals(own, window).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    spans = materialize(spans, "spans")
    none = F.array().cast("array<struct<start:int,length:int>>")
    joined = own.join(spans, ["doc", "tag"], "left").select(F.col("doc_id").cast("bigint"), "text", F.coalesce("spans", none).alias("spans"))
    out = joined.mapInArrow(tidy(_kept), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op10_window_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the 13-word windows of earlier ones."""
    return dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS t FROM words, unnest(range(1, len(w) - 11)) AS r(i)
),
hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM windows) WHERE least < doc_id
),
gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM hits, unnest(range(0, 13)) AS r(j)
),
each AS (
  SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS r(i)
),
kept AS (
  SELECT e.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY e.i) AS t
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
