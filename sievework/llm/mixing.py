"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Every document gets an exponential key: minus the logarithm of a uniform number that follows from its
doc_id, divided by its quality weight. Within a source, documents in the order of their keys are a
weighted sample without replacement. A source's target is cut into complete epochs, in which every
document is taken once, and a rest, which the documents with the smallest keys fill; the one at the
budget's end is taken in part, so that a source's taken words are its target, rounded.

Targets share all words by weight and stop at ``cap`` times their source's size. That is filling
vessels to one level: with sources ordered by the ratio of cap to weight, the level at which exactly
the whole stands follows from prefix sums.

Scale: the text is read once and never shuffled. A hot source is cut into ``buckets`` ranges of the
key, so a prefix sum needs a bucket's total and an order within one bucket alone. The only table in
one task is that of the sources' totals.

Defined cases: null text has size 0; null source is a source of its own, the last; null doc_id has
a key of its own; equal keys are ordered by doc_id and size, and rows equal in all of them share what
is taken in any order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialize, tagged

#: Characters that clean prose hardly has; their share lowers a document's quality weight.
JUNK = "0123456789#$%&*|!"
BUCKETS = 1024
CAP = 3
CYCLE = 3


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the squared share of characters that are not junk; 1 for no text."""
    n = F.length(text)
    clean = F.length(F.translate(text, JUNK, ""))
    share = F.when(n > 0, clean / n).otherwise(F.lit(1.0))
    return F.greatest(F.coalesce(share * share, F.lit(1.0)), F.lit(0.05))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the MD5 of the id, alike in every engine."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from one row a source with its size; weights are 1, 2, 3, repeating."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = F.when((F.col("level") >= F.col("above")) & (F.col("level") <= F.col("ratio")), F.col("level"))
    return (
        sources.withColumn("weight", (F.row_number().over(order) - 1) % CYCLE + 1)
        .withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("above", F.coalesce(F.lag("ratio").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("weight_left"))
        .withColumn("level", F.coalesce(F.min(level).over(everything), F.max("ratio").over(everything)))
        .select("source", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def sized(docs: DataFrame, weight: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row a document with its size, key and key range; ``keep`` names columns to carry along."""
    text = F.col("text")
    return (
        docs.select(
            *(keep or []),
            F.col("doc_id"),
            F.col("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
            (-F.log(uniform(F.col("doc_id"))) / (quality_weight(text) if weight is None else weight)).alias("sample_key"),
        )
        .withColumn("bucket", F.floor(BUCKETS * F.col("sample_key") / (1 + F.col("sample_key"))).cast("int"))
    )


def mix_sources(docs: DataFrame, cap: int = CAP, weight: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and sample_key of every document, and the columns to keep."""
    rows = materialize(sized(docs, weight, keep), "mixing")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    aims = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    # One row for each source and key range, so a hot source's documents meet many small rows.
    plan = starts.join(aims, starts["source"].eqNullSafe(aims["source"])).select(starts["source"].alias("s"), F.col("bucket").alias("b"), "bucket_start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("sample_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = own.join(plan, own["source"].eqNullSafe(plan["s"]) & (own["bucket"] == plan["b"]), "left")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = goal - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("bucket_start") - F.col("inside")))
    return joined.select(*(keep or []), "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "sample_key")


def mixed(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of the mix, with the columns of docs: a document once for each whole taking of it, and cut to its first words for the part taken at the budget's end.

    Rows alike in doc_id and text are one document here that takes what they take together.
    The words of a cut text are joined by single spaces; n_chars, where docs has it, is that of the row's text."""
    own = tagged(docs)
    plan = mix_sources(own, cap, keep=["__tag"])
    plan = plan.groupBy("doc_id", "__tag").agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("__tag").alias("__key"), "__size", "__taken")
    single = own.dropDuplicates(["doc_id", "__tag"])
    rows = single.join(plan, single["doc_id"].eqNullSafe(plan["__id"]) & (single["__tag"] == plan["__key"]))
    rows = rows.where("__taken > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("__taken") / F.col("__size")))))
    left = F.least(F.col("__size"), F.col("__taken") - (F.col("__n") - 1) * F.col("__size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD_CLASS})")), 1, left), " ")
    rows = rows.withColumn("text", F.when(left < F.col("__size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(left < F.col("__size"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with the words that the mix takes of it."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SIZED_SQL = r"""
sized AS (
  SELECT doc_id, source,
         CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / greatest(coalesce(power(CASE WHEN length(text) > 0 THEN length(translate(text, '0123456789#$%&*|!', ''))::DOUBLE / length(text) ELSE 1 END, 2), 1), 0.05) AS sample_key
  FROM {docs}
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
),
steps AS (
  SELECT *, 3 * source_size::DOUBLE / weight AS ratio FROM sources
),
levels AS (
  SELECT *, coalesce(lag(ratio) OVER w, 0) AS above,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM steps WINDOW w AS (ORDER BY ratio, source NULLS LAST)
),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * coalesce(min(CASE WHEN level >= above AND level <= ratio THEN level END) OVER (), max(ratio) OVER ())) AS target
  FROM levels
),
runs AS (
  SELECT s.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.sample_key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
"""

OP9_SQL = (
    "WITH "
    + SIZED_SQL.replace("{docs}", "documents")
    + """
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - before)) AS BIGINT) AS taken
FROM runs
"""
)
