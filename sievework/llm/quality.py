"""Quality classifier on random-indexing word vectors.

Words are hashed to ``BUCKETS`` rows. Each row has a sparse random index vector, a few places of +1 or -1. Over all
documents, the index vectors of a word's neighbours are added up in the word's context vector; words that
stand in like company come to have like vectors. A word counts under its own hash and under its shape (capitals, digits, the marks it ends
with), so that rare words carry what their form tells. A document is the mean of its words' vectors,
and a two-layer numpy network scores it; a temperature fitted on rows that the network
didn't see calibrates the scores.

Scale: the context vectors are sums, merged from one small table a task, of a size that doesn't depend on the
corpus. The corpus is read twice and never shuffled. The network is fitted on at most ``FIT_ROWS``
labelled rows, those with the smallest hashes of their ids, in the driver; where documents repeat those ids, on at most four
times as many, by id.

Defined cases: null and empty texts pool to the zero vector and get that vector's score; labels that are null
or name no document are left out; of repeated labels each counts; without labels, or with labels of
one kind, every score is the share of label 1 (0.5 without any); an empty table gives no rows; extra
columns are ignored. Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lowered, ship, span_hashes, tidy, words_of

BUCKETS = 1 << 13
SHAPES = 1 << 9
DIMENSIONS = 48
PLACES = 4
WINDOW = 2
HIDDEN = 32
#: Labelled rows that the network and its temperature are fitted on at most.
FIT_ROWS = 6000
FOLDS, HELD_FOLD = 3, 1
#: Parts of the context table, so that merging has several tasks.
PARTS = 16
#: Context tables that are merged in a first round, before the parts' totals.
SALTS = 64
BLOCK = 1 << 20


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id's text modulo 3; fold 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each row's sparse random index vector, from a fixed seed."""
    rng = np.random.default_rng(20240607)
    rows = BUCKETS + SHAPES
    places = np.argsort(rng.random((rows, DIMENSIONS)), axis=1)[:, :PLACES]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (rows, PLACES))


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small number for each word's form: first and last bytes' kinds, capitals, and marks within."""
    kind = np.full(256, 3, np.int64)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1], kind[128:] = 0, 1, 2, 0
    k = kind[buf]
    counts = [np.concatenate([[0], np.cumsum(k == i)]) for i in (1, 2, 3)]
    n = ends - starts
    capitals, digits, marks = (np.minimum(c[ends] - c[starts], n) for c in counts)
    level = lambda x: np.where(x == 0, 0, np.where(x == 1, 1, np.where(2 * x < n, 2, 3)))
    last = buf[ends - 1].astype(np.int64)
    ending = np.where(kind[last] == 3, 1 + last % 7, 0)
    return ((level(capitals) * 4 + level(marks)) * 4 + level(digits)) * 8 + ending


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row by hash and its row by shape, and the rows' word offsets."""
    starts, ends, rows = words_of(buf, offsets)
    h = span_hashes(lowered(buf), starts, ends)
    return (h % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shapes(buf, starts, ends), rows


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbours' index vectors, in parts."""
    places, signs = index_vectors()
    rows = BUCKETS + SHAPES
    dense = np.zeros((rows, DIMENSIONS))
    np.put_along_axis(dense, places, signs, 1)
    by_place, by_sign = np.ascontiguousarray(places.T), np.ascontiguousarray(signs.T)
    total, pairs = np.zeros((rows, DIMENSIONS)), np.zeros(SHAPES * SHAPES)
    for batch in batches:
        for _, _, buf, offsets in chunks(batch.column(0), BLOCK):
            word, shape, bounds = units(buf, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            for step in range(1, WINDOW + 1):
                if len(word) <= step:
                    continue
                near = np.flatnonzero(row[step:] == row[:-step])
                far = near + step
                for a, b in ((near, far), (far, near)):
                    base, other = word[a] * DIMENSIONS, word[b]
                    for at, sign in zip(by_place, by_sign, strict=True):
                        total += np.bincount(base + at[other], sign[other], rows * DIMENSIONS).reshape(rows, DIMENSIONS)
                    pairs += np.bincount((shape[a] - BUCKETS) * SHAPES + shape[b] - BUCKETS, minlength=SHAPES * SHAPES)
    total[BUCKETS:] += pairs.reshape(SHAPES, SHAPES) @ dense[BUCKETS:]
    task = TaskContext.get().partitionId()
    each = np.array_split(total, PARTS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(PARTS), pa.int32()), pa.array([task % SALTS] * PARTS, pa.int32()), pa.array([x.astype("<f8").tobytes() for x in each], pa.binary())], names=["part", "salt", "sums"]
    )


def _merge(batches: Iterator[pa.RecordBatch], by_salt: bool) -> Iterator[pa.RecordBatch]:
    """Sums by part, or by part and salt, holding one table of each."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, salt, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, x = (part, salt if by_salt else 0), np.frombuffer(data, "<f8")
            sums[key] = sums[key] + x if key in sums else x
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "salt", "sums"]
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all rows of the hashed vocabulary, over all documents."""
    ship(docs.sparkSession)
    schema = "part int, salt int, sums binary"
    own = docs.select("text").mapInArrow(tidy(_contexts), schema)
    first = own.repartition(4 * PARTS, "part", "salt").mapInArrow(tidy(_merge, True), schema)
    parts = first.repartition(PARTS, "part").mapInArrow(tidy(_merge, False), schema).collect()
    rows = {r["part"]: np.frombuffer(bytes(r["sums"]), "<f8") for r in parts}
    if not rows:
        return np.zeros((BUCKETS + SHAPES, DIMENSIONS), np.float32)
    table = np.concatenate([rows[i] for i in range(PARTS)]).reshape(BUCKETS + SHAPES, DIMENSIONS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(buf: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row's mean word vector, mean shape vector, and its length and variety of words."""
    word, shape, bounds = units(buf, offsets)
    n = np.diff(bounds)
    out = np.zeros((len(n), 2 * DIMENSIONS + 2), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        at = bounds[:-1][full]
        for i, column in enumerate(np.ascontiguousarray(vectors.T)):
            out[full, i] = np.add.reduceat(column[word], at) / n[full]
        row = np.repeat(np.arange(len(n)), n)
        forms = np.bincount(row * SHAPES + shape - BUCKETS, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
        out[:, DIMENSIONS : 2 * DIMENSIONS] = forms @ vectors[BUCKETS:] / np.maximum(n, 1)[:, None]
        code = row * BUCKETS + word
        out[:, -1] = np.bincount(np.unique(code) // BUCKETS, minlength=len(n)) / np.maximum(n, 1)
    out[:, -2] = np.log1p(n) / 10
    return out


def _features(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in chunks(batch.column(2), BLOCK):
            x = pooled(buf, offsets, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])


class Network:
    """Two layers, fitted by Adam from a fixed seed; then a temperature on rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64):
        self.share = float(y.mean()) if len(y) else 0.5
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            return
        rng = np.random.default_rng(7)
        order = rng.permutation(len(y))
        aside, own = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-3
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        # Both labels weigh alike, so a rare one isn't drowned; the temperature then sees the true shares.
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
                a = np.tanh(z[rows] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-(a @ p[2] + p[3]))) - y[rows]) / len(rows)
                back = np.outer(e, p[2]) * (1 - a * a)
                grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), a.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logit, target = self.logits(x[aside]), y[aside]
        loss = lambda temperature: np.logaddexp(0, np.where(target == 1, -1, 1) * logit / temperature).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-500, 500)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, limit: int = FIT_ROWS) -> Network:
    """The network from labelled rows outside the held-out fold, at most ``limit``, those with the smallest hashed ids."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_FOLD))
        .select("doc_id", F.col("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(limit)
    )
    # ``limit`` rows at most are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(tidy(_features, vectors), "doc_id bigint, label double, x binary").orderBy("doc_id", "label", "x").limit(4 * limit).collect()
    if not got:
        return Network(np.zeros((0, 2 * DIMENSIONS + 2)), np.zeros(0))
    return Network(np.stack([np.frombuffer(bytes(r["x"]), "<f4") for r in got]).astype(np.float64), np.array([r["label"] for r in got]))


def _scored(docs: DataFrame, labels: DataFrame, limit: int, carry: list[str], least: float | None) -> DataFrame:
    """The carried columns and the score of rows with at least that score; the text is read from the column after the carried ones."""
    vectors = word_vectors(docs)
    network = fit(docs, labels, vectors, limit)
    texts = carry.index("text") if "text" in carry else len(carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column(texts), BLOCK):
                found = network.scores(pooled(buf, offsets, vectors))
                columns = [batch.column(i).slice(a, b - a) for i in range(len(carry))]
                if least is not None:
                    at = pa.array(np.flatnonzero(found >= least))
                    yield pa.RecordBatch.from_arrays([c.take(at) for c in columns], names=carry)
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*carry, "score"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["score double"] * (least is None)
    return docs.select(*carry, *(["text"] if texts == len(carry) else [])).mapInArrow(tidy(score), ", ".join(kinds))


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id and score of every row."""
    return _scored(docs, labels, limit, ["doc_id"], None)


def good(docs: DataFrame, labels: DataFrame, least: float = 0.5, limit: int = FIT_ROWS) -> DataFrame:
    """The rows of docs with at least that score, with all their columns."""
    return _scored(docs, labels, limit, docs.columns, least)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its quality score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_scores(docs, labels)
    return scores.select("doc_id", (fold(F.col("doc_id")) == HELD_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
