"""Suffix-array dedup: removes the bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else.

Every place of a text starts a window of LENGTH bytes, and windows that repeat have to be found among all suffixes of the
corpus. Three exact reductions leave few suffixes to sort. A window's key is its smallest 32-byte gram, and consecutive windows with one key form a
run (see ``runs``); a count-min sketch drops runs whose gram occurs once. Runs with equal bytes are counted together by a
128-bit digest: all windows of a run that occurs twice repeat. What is left are grams whose runs differ: one
copy of each such run goes to its gram's bucket, where the suffixes of the bucket's runs are sorted by
hash comparisons (``suffix_sort``), and neighbours with LENGTH bytes in common are the repeated windows.

Scale: the sketch grows with the corpus up to 32 MB a row in each worker; beyond that more runs pass, and none is lost. Runs are grouped by aggregation with partial sums. A gram with more than ``BUCKET``
different runs (a very common line in ever different surroundings) isn't put into one task: its windows are dealt
by digests of their own, and counted. Texts are shuffled for the runs that have to be sorted and once for the result.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows that repeat, with their doc_id or with
another, repeat each other's bytes; null doc_id is a document like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, keyed, materialize, merged_spans, ship, span_digests, tidy
from .runs import cells_for, maybe_repeated, repeated_cells, sketched, window_runs
from .suffix_sort import sort_suffixes

LENGTH, GRAM = 200, 32
#: Different runs of one gram that are sorted together in one task at most: some 2 MB of text, 200 MB of arrays.
BUCKET = 8192
BLOCK = 1 << 20
#: Bytes of text for each cell of the sketch: about five cells a run.
CELL_TEXT = 16
REFS = "doc bigint, tag bigint, v bigint, d1 bigint, d2 bigint, start int, n int"


def _runs(column: pa.Array, length: int) -> Iterator[tuple]:
    """Of blocks of rows: their number in the column, the bytes, each run's row's offset, and the runs' rows, starts, numbers of windows and grams."""
    gram = min(GRAM, length)
    for a, _, buf, offsets in chunks(column, BLOCK):
        grams = gram_hashes(buf.astype(np.uint64) + np.uint64(1), gram) if len(buf) else np.zeros(0, np.uint64)
        row, start, n, v = window_runs(grams, offsets, length, gram)
        yield a, buf, offsets[row], row, start, n, v


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """The runs that the sketch counts twice or more, with digests of their bytes."""
    count = cells_for(docs, CELL_TEXT)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketched((r[-1] for batch in batches for r in _runs(batch.column(0), length)), count)

    bits = repeated_cells(docs.select("text").mapInArrow(tidy(sketch), "shard int, cells binary"), count)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, buf, base, row, start, n, v in _runs(batch.column(2), length):
                ok = np.flatnonzero(maybe_repeated(v, bits))
                start, n = start[ok], n[ok]
                d = span_digests(buf, start, start + n + length - 1)
                at = pa.array(row[ok] + a)
                columns = [pa.array(v[ok].view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(start - base[ok], pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc", "tag", "v", "d1", "d2", "start", "n"])

    return materialize(docs.select("doc", "tag", "text").mapInArrow(tidy(scan), REFS), "runs")


SPANS = "array<struct<start:int,n:int,v:bigint,alone:boolean,large:boolean>>"


def _listed(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(row, bytes of the row's text, its listed runs) of a batch of doc, tag, text and spans."""
    texts, lists = batch.column(2), batch.column(3)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    fields = [lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5)]
    for i in range(batch.num_rows):
        yield i, texts[i].as_buffer(), [f[bounds[i] : bounds[i + 1]] for f in fields]


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed runs whose gram has few."""
    for batch in batches:
        rows, columns, data = [], [[] for _ in range(4)], []
        for i, text, (start, n, v, alone, large) in _listed(batch):
            small = np.flatnonzero(~large.astype(bool))
            rows += [i] * len(small)
            for out, x in zip(columns, (start, n, v, alone), strict=True):
                out.append(x[small])
            data += [text[a:b].to_pybytes() for a, b in zip(start[small].tolist(), (start + n + length - 1)[small].tolist(), strict=True)]
        start, n, v, alone = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(v, pa.int64()), pa.array(alone.astype(bool)), pa.array(data, pa.binary())],
            names=["doc", "tag", "start", "n", "v", "alone", "data"],
        )


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digests of every window of the listed runs whose gram has many."""
    for batch in batches:
        for i, text, (start, n, _, alone, large) in _listed(batch):
            many = np.flatnonzero(large.astype(bool))
            if not len(many):
                continue
            size = n[many].astype(np.int64)
            at = np.repeat(start[many] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            d = span_digests(np.frombuffer(text, np.uint8), at, at + length)
            keys = pa.array(np.full(len(at), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keys), batch.column(1).take(keys), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(at, pa.int32()), pa.array(np.repeat(alone[many].astype(bool), size))],
                names=["doc", "tag", "w1", "w2", "start", "alone"],
            )


def repeated_windows(data: list[bytes], n: np.ndarray, v: np.ndarray, length: int) -> np.ndarray:
    """For each window of the runs, one run after the other, whether its bytes also start elsewhere under the same gram."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    first = np.cumsum(sizes) - sizes
    n = n.astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    order, same = sort_suffixes(np.frombuffer(b"".join(data), np.uint8), first[run] + inside, v[run], length)
    hit = np.zeros(len(run), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    return hit


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that repeat, from runs in the order of their grams; only runs that stand alone are reported."""
    held: list[pa.RecordBatch] = []
    size = 0

    def judge(part: pa.Table) -> pa.RecordBatch:
        start, n, v, alone = (part.column(c).to_numpy() for c in ("start", "n", "v", "alone"))
        hit = repeated_windows(part.column("data").to_pylist(), n, v, length)
        run = np.repeat(np.arange(len(n)), n)
        hit &= alone[run]
        inside = np.arange(len(run)) - np.repeat(np.cumsum(n.astype(np.int64)) - n, n)
        places = np.flatnonzero(hit)
        # Neighbouring windows of a run become one span.
        new = np.append(True, (np.diff(places) > 1) | (run[places][1:] != run[places][:-1]))[: len(places)]
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(places)))
        at = places[heads]
        rows = pa.array(run[at])
        table = part.combine_chunks()
        doc, tag = (table.column(c).combine_chunks().take(rows) for c in ("doc", "tag"))
        return pa.RecordBatch.from_arrays([doc, tag, pa.array(start[run[at]] + inside[at], pa.int32()), pa.array(count + length - 1, pa.int32())], names=["doc", "tag", "start", "length"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > BLOCK:
            table = pa.Table.from_batches(held)
            v = table.column("v").to_numpy()
            whole = int(np.searchsorted(v, v[-1]))  # the last gram may go on
            if whole:
                for a, b in _cuts(v[:whole], table.column("data"), BLOCK):
                    yield judge(table.slice(a, b - a))
            held = table.slice(whole).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            for a, b in _cuts(table.column("v").to_numpy(), table.column("data"), BLOCK):
                yield judge(table.slice(a, b - a))


def _cuts(v: np.ndarray, data: pa.ChunkedArray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes together, cut where the gram changes."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.binary_length(data.slice(0, len(v))).to_numpy().astype(np.int64))
    edges = np.append(np.flatnonzero(np.diff(v)) + 1, len(v))
    a = 0
    while a < len(v):
        used = total[a - 1] if a else 0
        b = int(edges[min(len(edges) - 1, np.searchsorted(edges, max(a + 1, np.searchsorted(total, used + size))))])
        yield a, b
        a = b


def removals(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc, tag, start and length of spans to remove; spans may overlap."""
    refs = repeated_runs(docs, length)
    mark = F.xxhash64("doc", "tag", "start")
    kinds = materialize(refs.groupBy("v", "d1", "d2").agg(F.count("*").alias("copies"), F.min(mark).alias("chosen")), "kinds")
    mixed = materialize(kinds.groupBy("v").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1").select("v", "kinds"), "mixed")
    kinds = materialize(kinds.join(mixed, "v", "left").where("copies > 1 or kinds is not null").select("d1", "d2", "copies", "chosen", "kinds"), "repeated")
    judged = refs.join(kinds, ["d1", "d2"]).select("doc", "tag", "start", "n", "v", "copies", "kinds", (F.col("kinds").isNotNull() & (mark == F.col("chosen"))).alias("speaks"))
    judged = materialize(judged.where("copies > 1 or speaks"), "judged")
    whole = judged.where("copies > 1").select("doc", "tag", "start", (F.col("n") + length - 1).alias("length"))
    span = F.struct("start", "n", "v", (F.col("copies") == 1).alias("alone"), (F.col("kinds") > bucket).alias("large"))
    listed = judged.where("speaks").groupBy("doc", "tag").agg(F.sort_array(F.collect_set(span)).cast(SPANS).alias("spans"))
    texts = docs.select("doc", "tag", "text").dropDuplicates(["doc", "tag"])
    asked = materialize(texts.join(listed, ["doc", "tag"]).select("doc", "tag", "text", "spans"), "asked")
    spans = asked.mapInArrow(tidy(_spans, length), "doc bigint, tag bigint, start int, n int, v bigint, alone boolean, data binary")
    small = materialize(spans.repartition("v").sortWithinPartitions("v").mapInArrow(tidy(_sorted_buckets, length), "doc bigint, tag bigint, start int, length int"), "sorted")
    many = asked.where(F.exists("spans", lambda x: x["large"]))
    windows = materialize(many.mapInArrow(tidy(_windows, length), "doc bigint, tag bigint, w1 bigint, w2 bigint, start int, alone boolean"), "windows")
    often = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("copies")).where("copies > 1").select("w1", "w2"), "windows-often")
    single = windows.where("alone").join(often, ["w1", "w2"]).select("doc", "tag", "start", F.lit(length).alias("length"))
    return whole.unionByName(small).unionByName(single)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        spans = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        start, length = (spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for a, b, buf, offsets in chunks(batch.column(1), BLOCK):
            data, rows = memoryview(buf.tobytes()), []
            for i in range(a, b):
                text = data[offsets[i - a] : offsets[i - a + 1]]
                own = slice(bounds[i], bounds[i + 1])
                s, e = merged_spans(start[own], start[own] + length[own])
                cuts = [0, *np.column_stack([s, e]).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def dedup_bytes(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    ship(docs.sparkSession)
    own = keyed(docs)
    spans = materialize(removals(own, length, bucket).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans")), "spans")
    none = F.array().cast("array<struct<start:int,length:int>>")
    joined = own.join(spans, ["doc", "tag"], "left").select(F.col("doc_id").cast("bigint"), "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(tidy(_kept), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the 200-byte strings that stand elsewhere too."""
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Bytes as two hexadecimal digits each; a window is named by the MD5 of its digits.
OP3_SQL = r"""
WITH bytes AS (SELECT doc_id, row_number() OVER () AS d, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT d, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM bytes, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS r(p)),
often AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
hits AS (SELECT d, p FROM windows WHERE m IN (SELECT m FROM often)),
heads AS (SELECT d, p, coalesce(p > lag(p) OVER (PARTITION BY d ORDER BY p) + 200, true) AS head FROM hits),
runs AS (SELECT d, p, sum(CAST(head AS INT)) OVER (PARTITION BY d ORDER BY p) AS run FROM heads),
spans AS (SELECT d, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY d, run),
gaps AS (SELECT d, a, b, lag(b) OVER (PARTITION BY d ORDER BY a) AS before FROM spans),
pieces AS (
  SELECT g.d, string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' ORDER BY a) AS t, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS last FROM gaps g JOIN bytes y ON g.d = y.d GROUP BY g.d
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM bytes y LEFT JOIN pieces p ON y.d = p.d
"""
