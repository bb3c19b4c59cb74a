"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample of the vectors by hyperplanes across random directions, at the median,
until a leaf holds about ``LEAF`` of the sample. Every row of the table is then routed to one leaf of each tree. A
query goes down all trees at once with one priority queue: the subtrees on the far side of a hyperplane wait
in it by the margins crossed, whichever tree they belong to, and the most promising is opened next, until the
opened leaves hold enough rows: how many that takes is measured on the sample. Rows and queries meet by leaf, and cosines in double precision
rank the candidates exactly.

Scale: trees are a bounded size whatever the table. Of rows with one and the same vector, only the k + 1 with
the smallest ids can be among anyone's k nearest, as ties go to smaller ids and one of them may be the query itself; a
window keeps those, so a vector that a third of all rows share fills no leaf. Queries with one vector
are searched once and get their own answers from it. A leaf with more rows than ``SPLIT`` is dealt to
several tasks, and each gets the leaf's queries. Queries are N / 50 and a leaf's rows grow with N beyond the
sample's size, so raise ``SAMPLE`` with the table.

Defined cases: null and zero vectors, and those with null or non-finite components, take no part, as queries or
as candidates; rows with null ids take none; of rows with the same id the nearest counts, and a query leaves out all rows with its own id; vectors whose length differs
from the most common one take no part; fewer candidates than k are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, tidy

TREES = 12
#: Rows that the trees are fitted on at most, by the smallest hashes of their ids.
SAMPLE = 16384
#: Rows of the sample in a leaf.
LEAF = 128
#: The opened leaves hold at least that share of the rows together (a row counts in every tree) with which the sample's own searches find
#: this part of their neighbours, and at least this number of rows. Vectors without structure, such as isotropic noise, need over half of the rows; clustered ones far less.
RECALL, SEARCH_LEAST = 0.95, 3000
#: Rows of the sample that are searched to find the share.
TRIALS = 512
#: Rows of a leaf that one task handles.
SPLIT = 4096
#: Directions tried at a node; the one along which the sample spreads most is taken.
TRIES = 5
EVERY = 50
K = 5


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: exact, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True, initial=0))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Forest:
    """Trees as arrays: for node i a hyperplane, its offset, and two children; a negative child -1 - j is leaf j. Leaves are numbered through all trees."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.roots = [self._grow(sample, np.arange(len(sample)), rng, leaf) for _ in range(trees)]
        self.plane = np.array(self.planes, np.float32).reshape(len(self.planes), sample.shape[1])
        self.offset = np.array(self.offsets, np.float32)
        self.child = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        if len(rows) > leaf:
            tried = []
            for _ in range(TRIES):
                a, b = x[rng.choice(rows, 2, replace=False)]
                if norm := np.linalg.norm(a - b):
                    plane = (a - b) / norm
                    side = x[rows] @ plane
                    tried.append((float(side.var()), plane, side))
            if tried:
                _, plane, side = max(tried, key=lambda t: t[0])
                cut = float(np.median(side))
                right = side > cut
                if 0 < right.sum() < len(rows):
                    at = len(self.planes)
                    self.planes.append(plane)
                    self.offsets.append(cut)
                    self.children.append([0, 0])
                    self.children[at] = [self._grow(x, rows[~right], rng, leaf), self._grow(x, rows[right], rng, leaf)]
                    return at
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.plane[node]) > self.offset[node]
                at[inner] = self.child[node, right.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves in the order that the shared queue opens them, until they hold enough rows."""
        sides = self.plane @ q - self.offset
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            margin, at = heapq.heappop(queue)
            while at >= 0:
                side = float(sides[at])
                right = side > 0
                # The squared margins crossed on the way to a subtree add up to about the squared distance to it.
                heapq.heappush(queue, (margin + side * side, int(self.child[at, 1 - right])))
                at = int(self.child[at, int(right)])
            found.append(-1 - at)
            held += int(sizes[-1 - at])
        return found


def share_for(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> float:
    """The share of the rows that searches must open to find ``recall`` of the k nearest, by rows of the sample against all of it.

    A table's neighbours are nearer than its sample's, and nearer ones share leaves more often, so the table needs no more."""
    x = sample.astype(np.float32)
    leaf = forest.route(x)
    sizes = np.bincount(leaf.ravel(), minlength=forest.leaves)
    needs = [np.zeros(0)]
    for i in np.random.default_rng(7).permutation(len(x))[:trials]:
        near = x @ x[i]
        near[i] = -np.inf
        keep = min(k, len(x) - 1)
        best = np.argpartition(-near, keep)[:keep]
        order = np.array(forest.search(x[i], sizes, len(x) * len(forest.roots) + 1))
        before = np.empty(forest.leaves, np.int64)
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        needs.append(before[leaf[best]].min(1) + 1)
    needs = np.concatenate(needs)
    return float(np.quantile(needs, recall, method="higher")) / len(x) if len(needs) else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _kind(table: DataFrame) -> str:
    """What vectors travel as: all arithmetic is in double precision, but floats take half the room."""
    own = table.schema["embedding"].dataType.simpleString()
    return own if own == "array<float>" else "array<double>"


def taking_part(table: DataFrame) -> DataFrame:
    """vec_id and v, an array of floats where the table has floats, else of doubles, of the rows that can be compared."""
    v = F.col("embedding").cast(_kind(table))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = table.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def nearest(table: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, sample: int = SAMPLE, share: float | None = None, least: int = SEARCH_LEAST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for every row whose id is divisible by ``every``; without a ``share`` of the rows to open, the sample tells it."""
    spark = table.sparkSession
    ship(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = taking_part(table)
    # One row of each id and vector is enough as a candidate; then the k + 1 smallest ids of each vector.
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = materialize(rows.distinct().withColumn("first", first).where(F.col("first") <= k + 1), "vectors")
    distinct = index.where("first = 1").select(F.col("vec_id").alias("vector"), "v")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = materialize(asked.join(distinct, "v").select("vec_id", "vector"), "queries")
    fitted = distinct.orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()  # ``sample`` rows at most
    if not fitted:
        return spark.createDataFrame([], schema)
    known = unit(np.array([r["v"] for r in fitted]))
    forest = Forest(known, trees)
    share = share_for(forest, known, k) if share is None else share

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = forest.route(unit(_matrix(batch.column(1))).astype(np.float32))
            row = np.repeat(np.arange(batch.num_rows), leaf.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel(), pa.int64()), batch.column(0).take(pa.array(row))], names=["leaf", "vec_id"])

    homes = materialize(index.select("vec_id", "v").mapInArrow(tidy(route), "leaf bigint, vec_id bigint"), "homes")
    held = homes.groupBy("leaf").count().collect()  # leaves are bounded by the sample
    sizes = np.zeros(forest.leaves, np.int64)
    sizes[[r["leaf"] for r in held]] = [r["count"] for r in held]
    total = int(sizes.sum()) // trees
    enough = max(least, int(share * total))
    tasks = np.maximum(1, -(-sizes // SPLIT))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves, parts, vectors = [], [], [], []
            x = unit(_matrix(batch.column(1))).astype(np.float32)
            for i, q in enumerate(x):
                for leaf in forest.search(q, sizes, enough):
                    for part in range(int(tasks[leaf])):
                        ids.append(i)
                        leaves.append(leaf)
                        parts.append(part)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(parts, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "part", "vector", "q"])

    # Each distinct query vector once, wherever its copies are asked.
    wanted = asked.select("vector").distinct().join(distinct, "vector").select("vector", "v")
    visits = wanted.mapInArrow(tidy(search), f"leaf bigint, part int, vector bigint, q {_kind(table)}")
    many = [int(i) for i in np.flatnonzero(tasks > 1)]
    counts = F.create_map(*[x for i in many for x in (F.lit(i), F.lit(int(tasks[i])))]) if many else None
    spread = F.coalesce(F.element_at(counts, F.col("leaf").cast("int")), F.lit(1)) if many else F.lit(1)
    members = homes.join(index.select("vec_id", "v"), "vec_id").select("leaf", F.pmod(F.xxhash64("vec_id"), spread).cast("int").alias("part"), "vec_id", "v")

    def rank(key: tuple, asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table({"vector": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = (_matrix(t.column(n).combine_chunks()) for t, n in ((asking, "q"), (held, "v")))
        ids = held.column("vec_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        near = unit(q) @ unit(x).T
        # Rows of one id take one place.
        each = near if len(heads) == len(ids) else np.maximum.reduceat(near, heads, axis=1)
        keep = min(len(heads), k + 1)
        # Whatever comes within rounding of the last place is scored exactly.
        bar = np.partition(each, len(heads) - keep, axis=1)[:, len(heads) - keep] - 1e-9
        a, b = np.nonzero(near >= bar[:, None])
        score = cosines(q[a], x[b])
        order = np.lexsort((-score, ids[b], a))
        order = order[np.append(True, (a[order][1:] != a[order][:-1]) | (ids[b[order]][1:] != ids[b[order]][:-1]))]
        order = order[np.lexsort((ids[b[order]], -score[order], a[order]))]
        place = np.arange(len(order)) - np.searchsorted(a[order], a[order])
        order = order[place < keep]
        return pa.table({"vector": asking.column("vector").combine_chunks().take(pa.array(a[order])), "vec_id": pa.array(ids[b[order]]), "score": pa.array(score[order])})

    found = visits.groupBy("leaf", "part").cogroup(members.groupBy("leaf", "part")).applyInArrow(rank, "vector bigint, vec_id bigint, score double")
    best = F.row_number().over(Window.partitionBy("vector").orderBy(F.desc("score"), "vec_id"))
    # A row is found in several trees; its score is the same in all.
    answers = found.groupBy("vector", "vec_id").agg(F.max("score").alias("score")).withColumn("place", best).where(F.col("place") <= k + 1)
    lists = materialize(answers.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")), "answers")
    own = asked.join(lists, "vector").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for equal vectors wherever they stand."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of ``embeddings`` for every 50th id."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
