"""Shared plumbing: tables cut from lineage, code shipped to executors, text as numpy buffers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of all contracts: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of text that numpy works on at once.
CHUNK = 1 << 20

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, _roots[app], True)
    return f"file://{_roots[app]}"


#: Drops the shuffle files of a query when it has ended; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at once: texts are long, and both sides hold a batch.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that lineage ends there and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once all that is made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(work: Callable[..., Iterator[pa.RecordBatch]], *args) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow; a worker that waits for its next task holds no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches, *args)
        finally:
            trim()

    return run


def trim() -> None:
    """Give freed memory back to the system, where that can be done."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null as the largest), tag and text: rows with one doc_id and different texts differ in tag, which follows from the content."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("doc_id", text).alias("tag"), text.alias("text"), "doc_id")


def tagged(docs: DataFrame) -> DataFrame:
    """docs with ``__tag``, which with doc_id names a row by its content."""
    return docs.withColumn("__tag", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs that chosen names by doc_id and tag, each once, with all their columns."""
    own = tagged(docs)
    names = chosen.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__key"))
    found = own.join(names, own["doc_id"].eqNullSafe(names["__id"]) & (own["__tag"] == names["__key"]), "left_semi")
    return found.dropDuplicates(["doc_id", "__tag"]).select(*docs.columns)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters on which it isn't installed; and keep batches for Python workers small where the session doesn't set their size."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sievework-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/sievework-{uuid.uuid4().hex[:8]}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(z.filename)
    _shipped.add(app)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about size bytes together; a longer row stands alone."""
    buf, offsets = text_buffer(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each row the index of its first word (with a last one for the end)."""
    solid = ~SPACES[buf]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    after[inner] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
        _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, back)]))
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, by differences of one prefix hash."""
    powers, inverse = _tables(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items, by doubling; entry i covers items i to i + k - 1."""
    out, size, have = None, 0, h
    step, width = h, 1
    while True:
        if k & width:
            if out is None:
                out, size = step, width
            else:
                m = max(0, min(len(out), len(step) - size))
                out = mix(out[:m] * np.uint64(0xD6E8FEB86659FD93) + step[size : size + m])
                size += width
        if size == k:
            return out[: max(0, len(have) - k + 1)]
        m = max(0, len(step) - width)
        step = mix(step[:m] * np.uint64(0xA0761D6478BD642F) + step[width : width + m])
        width *= 2


def span_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit BLAKE2 digest of each span of bytes, as two columns of 64-bit integers."""
    view, digest = memoryview(buf.tobytes()), hashlib.blake2b
    out = b"".join(digest(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(out, "<i8").reshape(-1, 2)


def squeezed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, their starts and ends there, and the rows' word offsets."""
    starts, ends, rows = words_of(buf, offsets)
    solid = ~SPACES[buf]
    size = ends - starts
    after = np.cumsum(size + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    filled = np.ones(len(out), bool)
    filled[after - 1] = False
    out[filled] = buf[solid]
    return out, after - 1 - size, after - 1, rows


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the spans cover together."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
