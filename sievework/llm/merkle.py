"""A Merkle manifest of a dataset: trees over its sources' rows, one tree over the sources' roots, and a proof for each row.

Rows are ordered by tree and key over range partitions, and counted, so that each partition knows at which leaf of a
tree it begins. It then builds its part as a range of mountains: a leaf goes on a stack, and whenever the nodes on it
complete a run of ``FANOUT`` they carry into their parent, whose record is written. What stays are the nodes of runs that begin or
end in other partitions. Those meet their neighbours in rounds of ``NEIGHBOURS`` partitions each, by the same stack; as each node
knows its tree's size, the last run of a level closes with the nodes it has, without padding, and a single last node becomes a parent of its own.

Proofs go down again, a band of ``BAND`` levels at a time: a block is the part of a tree under one node at the band's top, and
the siblings above it arrive as one string. So no row travels more than once, whatever the height.

Scale: leaf digests are made where the text is read, and texts are never shuffled. A tree with a third of all rows lies over as many partitions as
its rows need (equal rows, too: their place in the table splits them). A task streams through sorted rows and holds one stack, or the proofs
of one block. Partitions hand on at most ``FANOUT - 1`` nodes a level and side. Any number of sources is ordered and hashed the same way.

Defined cases: null fields count as ``-``; null source is a tree of its own, the first; null doc_id comes first in its tree and is
never tampered with; rows of one doc_id are ordered by their leaves, and equal rows are leaves side by side; an
empty table has no rows, no subroots and no root; one row is leaf, subroot and root at once, with an empty proof; texts of any length are hashed
whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, ship, tidy

FANOUT = 3
#: Adjacent partitions whose open nodes one merge takes together.
NEIGHBOURS = 64
#: Levels that a proof descends at once; a block has FANOUT ** BAND leaves at most.
BAND = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

LEAF, NODE, TOP, OPEN = range(4)

CELLS = "tree string, run bigint, kind int, level int, index bigint, size bigint, digest string, id bigint, note string"
PROOFS = "tree string, level int, index bigint, size bigint, proof string, place bigint, places bigint, subroot string, root string, digest string, id bigint, note string"
VERIFIED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, leaf_index bigint, leaves bigint"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(size: int, fanout: int = FANOUT) -> list[int]:
    """Number of nodes of each level, from the leaves to the single top."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def encoded(value: Column) -> Column:
    """A field's part of a leaf: - for null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row's fields, some of them changed."""
    return F.sha2(F.concat(*(encoded(changed.get(c, F.col(c))) for c in FIELDS)), 256)


class Peaks:
    """The stack over consecutive nodes of one tree: runs that wait for their next node, by level."""

    def __init__(self, size: int, fanout: int = FANOUT):
        self.fanout, self.counts = fanout, levels_of(size, fanout)
        self.waiting: list[list[tuple[int, str]]] = [[] for _ in self.counts]
        self.loose: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, digest: str) -> Iterator[tuple[int, int, int, str]]:
        """Put a node on the stack; gives kind, level, index and digest of every node that is complete now."""
        while level < len(self.counts) - 1:
            run = self.waiting[level]
            if run and (index % self.fanout == 0 or run[-1][0] != index - 1):
                self._loosen(level)
            run.append((index, digest))
            last = index == self.counts[level] - 1
            if not last and index % self.fanout < self.fanout - 1:
                return
            if len(run) <= index % self.fanout:  # the run begins in another partition
                self._loosen(level)
                return
            digest = sha256("".join(d for _, d in run))
            run.clear()
            level, index = level + 1, index // self.fanout
            if level < len(self.counts) - 1:
                yield NODE, level, index, digest
        yield TOP, level, index, digest

    def _loosen(self, level: int) -> None:
        self.loose.extend((level, *x) for x in self.waiting[level])
        self.waiting[level].clear()

    def rest(self) -> list[tuple[int, int, str]]:
        """Level, index and digest of the nodes whose runs aren't whole here."""
        for level in range(len(self.waiting)):
            self._loosen(level)
        return self.loose


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their place among its rows of the tree."""
    part, tree, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for name in batch.column(0).to_pylist():
            at = at + 1 if name == tree else 0
            tree = name
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def _mountains(batches: Iterator[pa.RecordBatch], merging: bool) -> Iterator[pa.RecordBatch]:
    """Cells of sorted rows (tree, run, level, index, size, digest, id, note): leaves as they are, the nodes they complete, and those left open."""

    def made() -> Iterator[tuple]:
        now, peaks = None, None

        def left() -> Iterator[tuple]:
            for level, index, digest in peaks.rest() if peaks else ():
                yield (now[0], now[1], OPEN, level, index, peaks.counts[0], digest, None, None)

        for tree, run, level, index, size, digest, id_, note in _rows(batches):
            if (tree, run) != now:
                yield from left()
                now, peaks = (tree, run), Peaks(size)
            if not merging:
                yield (tree, run, LEAF, 0, index, size, digest, id_, note)
            for kind, *node in peaks.push(level, index, digest):
                yield (tree, run, kind, node[0], node[1], size, node[2], None, None)
        yield from left()

    return _batched(made(), _arrow(CELLS))


@dataclass
class Trees:
    """The cells of trees (leaves, nodes, tops) in written tables, and the greatest size among them."""

    tables: list[DataFrame] = field(default_factory=list)
    largest: int = 0

    def cells(self) -> DataFrame:
        out = self.tables[0]
        for df in self.tables[1:]:
            out = out.unionByName(df)
        return out.where(F.col("kind") < OPEN)

    def tops(self) -> DataFrame:
        return self.cells().where(F.col("kind") == TOP).select("tree", "size", F.col("digest").alias("subroot"))

    def nodes(self) -> DataFrame:
        """tree, level, index and digest of every node above the leaves."""
        return self.cells().where((F.col("kind") != LEAF) & (F.col("level") > 0)).select("tree", "level", "index", "digest")


def grow(rows: DataFrame, keys: list[str]) -> Trees:
    """Trees over rows (tree, the keys, digest, id, note), which are the leaves of each tree in the order of the keys."""
    order = ["tree", *keys, "at"]
    leaves = rows.withColumn("at", F.monotonically_increasing_id())
    schema = ", ".join(f"{c} {t}" for c, t in leaves.dtypes)
    leaves = materialize(leaves, "merkle-leaves")  # range bounds are sampled from it, and the places stay as they are
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(ordered.mapInArrow(tidy(_numbered), f"{schema}, part int, place bigint"), "merkle-parts")
    release(leaves)
    by_tree = Window.partitionBy("tree")
    earlier = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        parts.groupBy("tree", "part").agg(F.count("*").alias("n"))
        .select("tree", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), F.sum("n").over(by_tree).alias("size"), (F.row_number().over(by_tree.orderBy("part")) - 1).cast("bigint").alias("run"))
    )
    indexed = parts.join(runs, ["tree", "part"]).select("tree", "run", F.lit(0).alias("level"), (F.col("first") + F.col("place")).alias("index"), "size", "digest", "id", "note")
    indexed = indexed.repartition("tree", "run").sortWithinPartitions("tree", "run", "index")
    tables = [materialize(indexed.mapInArrow(tidy(_mountains, False), CELLS), "merkle-cells")]
    release(parts)
    top = tables[0].agg(F.max("run").alias("run"), F.max("size").alias("size")).first()
    most = top["run"] or 0
    while most > 0:
        begin = (F.col("index") * F.pow(F.lit(float(FANOUT)), F.col("level"))).cast("bigint")
        loose = tables[-1].where(F.col("kind") == OPEN).withColumn("run", F.expr(f"run div {NEIGHBOURS}")).withColumn("begin", begin)
        loose = loose.repartition("tree", "run").sortWithinPartitions("tree", "run", "begin").select("tree", "run", "level", "index", "size", "digest", "id", "note")
        tables.append(materialize(loose.mapInArrow(tidy(_mountains, True), CELLS), "merkle-merged"))
        most //= NEIGHBOURS
    return Trees(tables, top["size"] or 0)


def _lowered(batches: Iterator[pa.RecordBatch], bottom: int) -> Iterator[tuple]:
    """Rows of sorted blocks with the siblings of every node on the way up, from the level ``bottom``.

    A block begins with its head, which holds the siblings above it; its levels follow from the highest on, each in the order of its nodes."""
    parents: dict[int, str] = {}
    found: dict[int, str] = {}
    run: list[tuple] = []
    head: tuple = ()
    level = -1

    def settled() -> Iterator[tuple]:
        for row in run:
            index, digest = row[3], row[6]
            proof = parents[index] if level == head[2] else "".join(x[6] for x in run if x is not row) + parents[index // FANOUT]
            if level == bottom:
                yield (head[0], level, index, row[4], proof, *head[7:11], digest, row[11], row[12])
            else:
                found[index] = proof
        run.clear()

    for row in _rows(batches):  # tree, is_head, level, index, size, proof, digest, place, places, subroot, root, id, note
        if row[1]:
            yield from settled()
            head, level, parents, found = row, row[2], {row[3]: row[5]}, {}
            continue
        if row[2] != level:
            yield from settled()
            if found:
                parents, found = found, {}
            level = row[2]
        elif run and run[-1][3] // FANOUT != row[3] // FANOUT:
            yield from settled()
        run.append(row)
    yield from settled()


def _proofs(batches: Iterator[pa.RecordBatch], bottom: int) -> Iterator[pa.RecordBatch]:
    return _batched(_lowered(batches, bottom), _arrow(PROOFS))


def folded(digest: str, siblings: str, path: list[tuple[int, int]]) -> str:
    """The root that a leaf and its siblings give, along (index, size) of the trees from the leaf's up."""
    used = 0
    for index, size in path:
        while size > 1:
            place = index % FANOUT
            count = min(FANOUT, size - index + place)
            left, end = used + 64 * place, used + 64 * (count - 1)
            digest = sha256(siblings[used:left] + digest + siblings[left:end])
            used, index, size = end, index // FANOUT, -(-size // FANOUT)
    return digest


def _verified(batches: Iterator[pa.RecordBatch], bottom: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for tree, _, index, size, proof, place, places, subroot, root, leaf, doc_id, altered in _lowered(batches, bottom):
            got = folded(leaf if altered is None else altered, proof, [(index, size), (place, places)])
            yield (doc_id, leaf, subroot, root, sha256(proof), got, got == root, tree[1:] if tree else None, index, size)

    return _batched(rows(), _arrow(VERIFIED))


def descend(trees: Trees, heads: DataFrame, last=_proofs, schema: str = PROOFS) -> tuple[DataFrame, list[DataFrame]]:
    """last's rows for every leaf, made of PROOFS, and the tables written on the way.

    heads: tree, size, proof (the siblings above the tree's top), place and places (of the top above), subroot and root."""
    height = len(levels_of(max(trees.largest, 1))) - 1
    cells, written = trees.cells().where(F.col("kind") != TOP), []
    nothing = lambda kind: F.lit(None).cast(kind)
    heads = heads.withColumn("level", sum((F.col("size") > FANOUT**k).cast("int") for k in range(height)) if height else F.lit(0))
    lowered = None
    for band in range(max(height - 1, 0) // BAND, -1, -1):
        low, high = band * BAND, (band + 1) * BAND
        own = (F.col("level") <= high) & ((F.col("level") > low) if low else F.lit(True))
        columns = ["tree", "level", "index", "size", "proof", "place", "places", "subroot", "root"]
        tops = heads.where(own).withColumn("index", F.lit(0).cast("bigint")).withColumn("block", F.lit(0).cast("bigint")).select(*columns, "block")
        if lowered is not None:
            tops = tops.unionByName(lowered.withColumn("block", F.col("index")).select(*columns, "block"))
        tops = tops.select("tree", "block", F.lit(True).alias("is_head"), "level", "index", "size", "proof", nothing("string").alias("digest"), "place", "places", "subroot", "root", nothing("bigint").alias("id"), nothing("string").alias("note"))
        block = F.expr(f"index div cast(pow({FANOUT}, {high} - level) as bigint)")
        inside = cells.where((F.col("level") >= low) & (F.col("level") < high)).select("tree", block.alias("block"), F.lit(False).alias("is_head"), "level", "index", "size", nothing("string").alias("proof"), "digest", *(nothing(t).alias(c) for c, t in (("place", "bigint"), ("places", "bigint"), ("subroot", "string"), ("root", "string"))), "id", "note")
        rows = tops.unionByName(inside).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("is_head"), F.desc("level"), "index").drop("block")
        if band == 0:
            return rows.mapInArrow(tidy(last, 0), schema), written
        lowered = materialize(rows.mapInArrow(tidy(_proofs, low), PROOFS), "merkle-band")
        written.append(lowered)


@dataclass
class Manifest:
    """The trees of the sources and the tree over their roots; ``sources.nodes()`` and ``whole.nodes()`` are their records."""

    sources: Trees
    whole: Trees

    def root(self) -> DataFrame:
        return self.whole.tops().select(F.col("subroot").alias("root"))

    def verified(self) -> DataFrame:
        """VERIFIED: every row's proof, and the root that its leaf as it is now gives with its siblings as they were."""
        root = self.whole.tops().select(F.lit("").alias("tree"), "size", F.lit("").alias("proof"), F.lit(0).cast("bigint").alias("place"), F.lit(1).cast("bigint").alias("places"), "subroot", F.col("subroot").alias("root"))
        above, first = descend(self.whole, root)
        above = materialize(above.select(F.col("note").alias("tree"), "proof", F.col("index").alias("place"), F.col("size").alias("places"), "root"), "merkle-above")
        out, second = descend(self.sources, self.sources.tops().join(above, "tree"), _verified, VERIFIED)
        result = materialize(out, "merkle-verified")
        release(above, *first, *second)
        return result

    def release(self) -> None:
        release(*self.sources.tables, *self.whole.tables)


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> Manifest:
    """The manifest of docs as they are; where ``tampered`` holds, a row's text is later found to be ``text``."""
    ship(docs.sparkSession)
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))  # an order without null: the null source first
    altered = F.lit(None).cast("string") if tampered is None else F.when(tampered & ~text.eqNullSafe(F.col("text")), leaf_digest(text=text))
    sources = grow(docs.select(tree.alias("tree"), leaf_digest().alias("digest"), F.col("doc_id").cast("bigint").alias("id"), altered.alias("note")), ["id", "digest"])
    tops = sources.tops().select(F.lit("").alias("tree"), F.col("subroot").alias("digest"), F.lit(None).cast("bigint").alias("id"), F.col("tree").alias("note"))
    return Manifest(sources, grow(tops, ["note"]))


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its proof, checked after the line breaks of every other one have been deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
    out = made.verified()
    made.release()
    return out


OP11_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, lang, n_chars, text, doc_id IS NOT NULL AND list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
              lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) % 2 = 1 AS even,
         coalesce('s' || source, '') AS tree
  FROM documents
),
fields AS (
  SELECT doc_id, source, tree, coalesce(even, false) AS tampered,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS before,
         text, replace(text, chr(10), '') AS cut
  FROM rows_
),
digests AS (
  SELECT doc_id, source, tree, sha256(before || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(before || coalesce(strlen(CASE WHEN tampered THEN cut ELSE text END) || ':' || CASE WHEN tampered THEN cut ELSE text END, '-')) AS found
  FROM fields
),
leaves AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS r
  FROM digests WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)
),
inner_ AS (
  SELECT tree, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM inner_ WHERE n > 1 GROUP BY tree, level, i // 3, n
),
tops AS (
  SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM inner_ WHERE n = 1
),
outer_ AS (
  SELECT 0 AS level, i, n, d FROM tops
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM outer_ WHERE n > 1 GROUP BY level, i // 3, n
),
steps AS (
  SELECT l.r, t.level AS step, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < l.i // (3 ** t.level)::BIGINT), '') AS before,
         coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > l.i // (3 ** t.level)::BIGINT), '') AS after
  FROM leaves l JOIN inner_ t ON t.tree = l.tree AND t.n > 1 AND t.i // 3 = l.i // (3 ** (t.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l.r, 100 + t.level, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < s.i // (3 ** t.level)::BIGINT), ''),
         coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > s.i // (3 ** t.level)::BIGINT), '')
  FROM leaves l JOIN tops s USING (tree) JOIN outer_ t ON t.n > 1 AND t.i // 3 = s.i // (3 ** (t.level + 1))::BIGINT GROUP BY ALL
),
ordered AS (SELECT r, before, after, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM steps),
folds AS (
  SELECT r, 0 AS k, found AS d FROM leaves
  UNION ALL
  SELECT f.r, o.k, sha256(o.before || f.d || o.after) FROM folds f JOIN ordered o ON o.r = f.r AND o.k = f.k + 1
),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM ordered GROUP BY r)
SELECT l.doc_id, l.leaf, t.d AS subroot, o.d AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = o.d AS verified,
       l.source, l.i AS leaf_index, l.n AS leaves
FROM leaves l JOIN tops t USING (tree) CROSS JOIN (SELECT d FROM outer_ WHERE n = 1) o LEFT JOIN proofs p USING (r)
JOIN (SELECT r, arg_max(d, k) AS d FROM folds GROUP BY r) f USING (r)
"""
