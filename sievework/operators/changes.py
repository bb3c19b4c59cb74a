"""What a change of lockfiles brings: changed packages, advisories before and after, whose findings count, and how to get to a fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from .deps import KINDS


def versions_by_name(packages: DataFrame) -> DataFrame:
    """lockfile, name and the distinct versions, in order; by the ecosystem's rules where packages state one."""
    v = F.array_sort(F.collect_set(F.struct(V.order_key(F.col("version"), V.stated(packages)).alias("k"), F.col("version").alias("v"))))
    return packages.groupBy("lockfile", "name").agg(F.transform(v, lambda x: x["v"]).alias("versions"))


def changed(packages: DataFrame, previous: DataFrame) -> DataFrame:
    """Packages whose version their name didn't have before, once each, with ``replaces``: the highest version it had, or null."""
    keys = ["lockfile", "name", "version"]
    new = packages.select(*keys).distinct().join(previous.select(*keys), keys, "left_anti")
    old = previous.groupBy("lockfile", "name").agg(F.max_by("version", F.struct(V.order_key(F.col("version"), V.stated(previous)), "version")).alias("replaces"))
    return new.join(old, ["lockfile", "name"], "left")


def ordered(found: DataFrame) -> DataFrame:
    """Changes with ``at``: their place by kind (additions first, removals last) and name within a lockfile."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return found.withColumn("at", F.row_number().over(Window.partitionBy("lockfile").orderBy(kind, "name", "from_version", "to_version")))


def tally(found: DataFrame) -> DataFrame:
    """Changes by lockfile and kind, kinds without any as 0."""
    return found.groupBy("lockfile").agg(*(F.count_if(F.col("kind") == k).alias(k.lower()) for k in KINDS))


def of_changed(findings: DataFrame, changed_: DataFrame) -> DataFrame:
    """Findings about packages that changed."""
    return findings.join(changed_.select("name", "version").distinct(), ["name", "version"], "left_semi")


def positional(queries: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, checks): answers come in the order of their queries, batch by batch (batch, at); a query without one is an incomplete check, not a pass."""
    both = queries.join(answers, ["batch", "at"], "left")
    checks = both.where("ids is null").groupBy("batch").agg(F.count("*").alias("unanswered")).withColumn("status", F.lit("incomplete"))
    return both.where("ids is not null"), checks


def by_query(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """One row a package with its advisories' ids in order and their worst severity; ids that no detail is known of count as critical."""
    rank = F.when(F.col("severity") == "low", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "high", 3).otherwise(4)
    each = rows.select("name", "version", F.explode("ids").alias("id")).join(advisories, "id", "left")
    return each.groupBy("name", "version").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max(rank).alias("worst"))


def unresolved(entries: DataFrame) -> DataFrame:
    """An incomplete check for each lockfile with entries that couldn't be pinned: how many, and the first three."""
    at = F.row_number().over(Window.partitionBy("lockfile").orderBy("entry"))
    few = F.array_sort(F.collect_set(F.when(F.col("at") <= 3, F.col("entry"))))
    return entries.where("not resolved").withColumn("at", at).groupBy("lockfile").agg(F.count("*").alias("unresolved"), few.alias("samples")).withColumn("status", F.lit("incomplete"))


def parents(edges: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """What requires a vulnerable package directly."""
    return vulnerable.select(F.col("node").alias("dst")).distinct().join(edges, "dst").select(F.col("dst").alias("node"), F.col("src").alias("parent")).distinct()


def lowest_parent(releases: DataFrame, targets: DataFrame) -> DataFrame:
    """For each parent (parent, version now, dep) the lowest release above it that permits a target of dep. releases: parent, release,
    dep, low and high: the versions of dep that it admits, from low up to high; pre-releases are taken only from pre-releases."""
    ecosystem = V.stated(releases)
    k = lambda v: V.order_key(v, ecosystem)
    above = releases.where((k(F.col("release")) > k(F.col("version"))) & (V.is_pre(F.col("version"), ecosystem) | ~V.is_pre(F.col("release"), ecosystem)))
    fits = above.join(targets, "dep").where((k(F.col("target")) >= k(F.col("low"))) & (k(F.col("target")) < k(F.col("high"))))
    return fits.groupBy("parent", "version", "dep").agg(F.min_by("release", k(F.col("release"))).alias("to"))


def guidance(vulnerable: DataFrame, requirements: DataFrame, upgrades: DataFrame) -> DataFrame:
    """node and step for vulnerable packages (node, edges_known, fix: the lowest safe version or null).

    requirements: node, parent, member, allows (null: unknown) of each package that requires one; upgrades: parent, node, to. Nothing blocked is a refresh; a blocking member's requirement has to be raised, a blocking parent upgraded where a release permits, else overridden."""
    blocked = requirements.where(~F.col("allows")).join(upgrades, ["parent", "node"], "left")
    step = F.when(F.col("member"), "raise").when(F.col("to").isNotNull(), "upgrade").otherwise("override")
    steps = blocked.groupBy("node").agg(F.array_sort(F.collect_set(step)).alias("steps"), F.count("*").alias("blocking"))
    unknown = requirements.where(F.col("allows").isNull()).groupBy("node").agg(F.count("*").alias("unknown"))
    rows = vulnerable.join(steps, "node", "left").join(unknown, "node", "left")
    first = F.when(F.col("fix").isNull(), F.array(F.lit("none"))).when(~F.col("edges_known"), F.array(F.lit("refresh"))).otherwise(F.coalesce("steps", F.array(F.lit("refresh"))))
    counts = lambda c: F.when(F.col("fix").isNotNull() & F.col("edges_known"), F.coalesce(c, F.lit(0))).otherwise(0)
    return rows.select("node", "fix", first.alias("steps"), counts("blocking").alias("blocking"), counts("unknown").alias("unknown"))


def lowest_fix(entries: DataFrame) -> DataFrame:
    """For each package the lowest of its advisories' fixes above its version, and how many have none."""
    k = lambda v: V.order_key(v, V.stated(entries))
    keyed = entries.select("name", "version", "fixed", k(F.col("fixed")).alias("key"), k(F.col("version")).alias("now"))
    above = lambda c: F.when(F.col("key") > F.col("now"), F.col(c))
    return keyed.groupBy("name", "version").agg(F.min_by(above("fixed"), above("key")).alias("fix"), F.count_if(above("fixed").isNull()).alias("without"))
