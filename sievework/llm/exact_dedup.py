"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of ``block_bytes``. All blocks are sorted and each distinct one
gets an integer name; then the names of adjacent blocks are paired, and the distinct pairs are sorted
and named in turn, until one name is left of each document. Two documents with the same number of
rounds have the same name exactly if their texts are equal: names are given by comparing contents,
so there are no collisions, at any size.

Scale: the text is shuffled once. Rows are range-partitioned by (hash of the content, document), so
copies of one block, however many, spread over as many tasks as their share needs, and sorted by
(hash, content) within. A task names its contents by their place in that order. A content can stand
in two tasks only where their ranges meet, so the contents at both ends of each task are compared once
more and given the smallest of their names; those are a few rows a task. Later rounds move integers
only, of documents longer than a block.

Defined cases: null text counts as empty; rows with the same doc_id are rows of their own, of equal
texts exactly one row is kept, that with the smallest doc_id (null last; among repeated doc_ids any one);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, keep_rows, materialize, ship, tidy

BLOCK_BYTES = 8192
#: A task's names start at its number times this.
STRIDE = 1 << 36


def normalized(text):
    """Each run of ASCII white space as one space; null as empty."""
    return F.coalesce(F.regexp_replace(text, f"{SPACE_CLASS}+", " "), F.lit(""))


def _name_sorted(batches: Iterator[pa.RecordBatch], payload: list[str]) -> Iterator[pa.RecordBatch]:
    """Names for rows sorted by (hash, content). Rows of contents that may go on in a neighbouring task carry the content in ``edge``."""
    name = TaskContext.get().partitionId() * STRIDE
    last = None  # hash and content of the row before
    first_hash, group = None, []  # contents and names under the hash at hand
    head: list = []
    schema = pa.schema([("name", pa.int64()), ("edge", pa.binary())])

    def edges(entries: list) -> pa.RecordBatch:
        own = [pa.array([n for _, n in entries], pa.int64()), pa.array([c for c, _ in entries], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.nulls(len(entries), t) for t in types] + own, names=[*payload, *schema.names])

    types: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        types = [batch.column(batch.schema.get_field_index(c)).type for c in payload]
        h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False)
        content = batch.column(batch.schema.get_field_index("content"))
        new = np.ones(len(h), bool)
        if len(h) > 1:
            same = pc.equal(content.slice(1), content.slice(0, len(content) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = (h[1:] != h[:-1]) | ~same
        if last is not None:
            new[0] = (int(h[0]), content[0].as_py()) != last
        names = name + np.cumsum(new)
        name = int(names[-1])
        last = (int(h[-1]), content[-1].as_py())
        if first_hash is None:
            first_hash = int(h[0])
        pick = lambda which: [(content[int(i)].as_py(), int(names[i])) for i in np.flatnonzero(new & (h == which))]  # noqa: B023, E731
        if int(h[0]) == first_hash:
            head += pick(first_hash)
        group = (group if group and int(h[0]) == int(h[-1]) == group[0] else [int(h[-1])]) + pick(h[-1])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in payload] + [pa.array(names, pa.int64()), pa.nulls(len(h), pa.binary())], names=[*payload, *schema.names])
    ends = {n: c for c, n in head + group[1:]}
    if ends:
        yield edges([(c, n) for n, c in sorted(ends.items())])


def named(rows: DataFrame, tag: str = "tag") -> DataFrame:
    """Give each distinct ``content`` (binary) of the rows an integer ``name``; the other columns stay."""
    spark = rows.sparkSession
    ship(spark)
    payload = [c for c in rows.columns if c != "content"]
    ordered = rows.withColumn("h", F.xxhash64("content")).repartitionByRange("h", tag).sortWithinPartitions("h", "content")
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in payload]
    table = materialize(ordered.mapInArrow(tidy(_name_sorted, payload), ", ".join([*kinds, "name bigint", "edge binary"])), "names")
    ends = table.where(F.col("edge").isNotNull()).select("edge", "name")
    smallest = ends.groupBy("edge").agg(F.min("name").alias("own"))
    # At most the contents at both ends of each task: a bound that doesn't depend on the rows.
    merged = ends.join(smallest, "edge").where("name <> own").select("name", "own").distinct()
    inner = table.where(F.col("edge").isNull()).drop("edge")
    return inner.join(F.broadcast(merged), "name", "left").select(*payload, F.coalesce("own", "name").alias("name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """tag, key, doc_id, text_sha256 and the identity (rounds, name) of every row; tag tells any two rows apart, key those of one doc_id with different texts."""
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("tag"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), normalized(F.col("text")).alias("t"))
    text = text.select("doc_id", "tag", "key", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.col("t").cast("binary").alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("t") / F.lit(block_bytes)).cast("int"))
    blocks = text.select(
        "tag",
        n.alias("n"),
        "key",
        "doc_id",
        "text_sha256",
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))).alias("i", "content"),
    )
    blocks = blocks.withColumns({"key": F.when(F.col("i") == 0, F.col("key")), "doc_id": F.when(F.col("i") == 0, F.col("doc_id")), "text_sha256": F.when(F.col("i") == 0, F.col("text_sha256"))})
    rows = materialize(named(blocks), "blocks")
    whole = rows.where("i = 0").select("tag", "key", "doc_id", "text_sha256", "n", F.col("name").alias("first"))
    longest = rows.agg(F.max("n")).first()[0] or 1
    if longest == 1:
        return whole.select("tag", "key", "doc_id", "text_sha256", F.lit(0).alias("rounds"), F.col("first").alias("name"))
    done, left, rounds = None, rows.where("n > 1").select("tag", "n", "i", "name"), 0
    while longest > 1:
        rounds += 1
        half = F.expr("i div 2").cast("int")
        pairs = left.groupBy("tag", "n", half.alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b")
        )
        content = F.concat(F.unhex(F.lpad(F.hex("a"), 16, "0")), F.unhex(F.lpad(F.hex("b"), 16, "0")))
        level = materialize(named(pairs.select("tag", F.ceil(F.col("n") / 2).cast("int").alias("n"), "i", content.alias("content"))), "pairs")
        ended = level.where("n = 1").select("tag", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
        left, longest = level.where("n > 1"), (longest + 1) // 2
    own = whole.where("n > 1").drop("n", "first").join(done, "tag")
    return whole.where("n = 1").select("tag", "key", "doc_id", "text_sha256", F.lit(0).alias("rounds"), F.col("first").alias("name")).unionByName(own)


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept and text_sha256 of every row."""
    rows = materialize(identities(docs, block_bytes), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tag"))
    groups = rows.groupBy("rounds", "name").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    # Both sides are plain tables, so adaptive execution splits the rows of a hot group.
    joined = rows.join(materialize(groups, "groups"), ["rounds", "name"], "left")
    return joined.select(
        "doc_id", "key", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.tag") == F.col("tag"), F.lit(True)).alias("kept"), "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, exact_groups(docs).where("kept").select("doc_id", F.col("key").alias("tag")))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with the copy that stays."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


GROUPS_SQL = r"""
normal AS (SELECT *, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM {docs})
"""

OP2_SQL = (
    "WITH "
    + GROUPS_SQL.replace("{docs}", "documents")
    + """
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""
)
