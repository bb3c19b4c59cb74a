"""Dependency trees: differences, reasons, release signals, source policies, name guard, bill of materials."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import settled
from ..functions import versions as V

# Fixed value: the order of kinds of change.
KINDS = ("Added", "Upgraded", "Downgraded", "Removed")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """lockfile, name, from_version, to_version and kind: versions on both sides drop out, the others pair up by name in version order, leftovers are added or removed.

    Where both sides state an ecosystem, it belongs to the name and its rules order the versions."""
    both_state = "ecosystem" in old.columns and "ecosystem" in new.columns
    name = ["lockfile", *(["ecosystem"] if both_state else []), "name"]
    keys = [*name, "version"]
    key = lambda c: V.order_key(F.col(c), F.col("ecosystem") if both_state else None)
    by = Window.partitionBy(*name).orderBy(key("version"), "version")
    left, right = (a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").withColumn("k", F.row_number().over(by)) for a, b in ((old, new), (new, old)))
    both = left.withColumnRenamed("version", "from_version").join(right.withColumnRenamed("version", "to_version"), [*name, "k"], "full_outer")
    up = key("to_version") >= key("from_version")
    kind = F.when(F.col("from_version").isNull(), "Added").when(F.col("to_version").isNull(), "Removed").when(F.coalesce(up, F.lit(True)), "Upgraded").otherwise("Downgraded")
    return both.select(*name, "from_version", "to_version", kind.alias("kind"))


def why(spark, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth and chain: a shortest chain of dependencies from a root to each node, the first by name.

    Level by level, so each node is settled once; a tree's depth bounds the rounds."""
    level = roots.select("node", F.array("node").alias("chain")).distinct()
    found = level.withColumn("depth", F.lit(0))
    for depth in count(1):
        step = level.join(edges, level["node"] == edges["src"]).select(edges["dst"].alias("node"), F.concat("chain", F.array(edges["dst"])).alias("chain"))
        step = step.groupBy("node").agg(F.min("chain").alias("chain")).join(found.select("node"), "node", "left_anti")
        step = settled(step)
        if step.isEmpty():
            break
        found = found.unionByName(step.withColumn("depth", F.lit(depth)))
        level = step
    return found


def why_sql(edges: str, roots: str) -> str:
    """The same distances as one recursive query over views, for trees: it goes by paths, and has no bound of its own. Trees deeper than the session's
    spark.sql.cteRecursionLevelLimit, cycles, and graphs with more paths than its row limit raise; ``why`` takes them all."""
    return f"""WITH RECURSIVE reach (node, depth) AS (
  SELECT node, 0 FROM {roots} UNION ALL
  SELECT e.dst, r.depth + 1 FROM reach r JOIN {edges} e ON e.src = r.node
) SELECT node, min(depth) AS depth FROM reach GROUP BY node"""


def direct(edges: DataFrame, members: DataFrame) -> DataFrame:
    return edges.join(members.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def orphans(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.join(reached, "node", "left_anti")


def previous_release(releases: DataFrame) -> DataFrame:
    """releases with ``previous``: the highest version below; pre-releases are the previous of pre-releases only."""
    keyed = releases.withColumn("k", V.order_key(F.col("version"), V.stated(releases))).withColumn("pre", V.is_pre(F.col("version"), V.stated(releases)))
    before = Window.partitionBy("package").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    stable = F.last(F.when(~F.col("pre"), F.col("version")), ignorenulls=True).over(before)
    return keyed.withColumn("previous", F.when(F.col("pre"), F.last("version", ignorenulls=True).over(before)).otherwise(stable)).drop("k", "pre")


def earlier_publishers(releases: DataFrame) -> DataFrame:
    """releases with ``earlier``: the distinct publishers of lower versions, sorted.

    Only each publisher's lowest release adds to what comes later, so the running list grows with a package's publishers, not its releases."""
    keyed = releases.withColumn("k", V.order_key(F.col("version"), V.stated(releases)))
    own = keyed.withColumn("new", F.when(F.row_number().over(Window.partitionBy("package", "publisher").orderBy("k")) == 1, F.col("publisher")))
    before = Window.partitionBy("package").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("earlier", F.array_sort(F.collect_list("new").over(before))).drop("k", "new")


def release_signals(releases: DataFrame, now: Column, cooldown_hours: int = 24) -> DataFrame:
    """One row a signal. What the registry didn't tell is null and raises none."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("published")) / 3600)
    c = F.col
    tests = {
        "RELEASE/YoungRelease": age < cooldown_hours,
        "RELEASE/NewInstallScript": c("install_script") & ~c("previous_install_script"),
        "RELEASE/ProvenanceRegression": c("previous_provenance") & ~c("provenance"),
        "RELEASE/PublisherChange": c("publisher").isNotNull() & ~F.coalesce(c("provenance"), F.lit(False)) & (F.size("earlier") > 0) & ~F.array_contains("earlier", c("publisher")),
        "RELEASE/Withdrawn": c("withdrawn").isNotNull(),
    }
    found = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))
    return releases.withColumn("rule", F.explode(found))


def internal(name: Column, pattern: str) -> Column:
    """Whether a package name falls under a pattern: prefix*, a bare @scope, or the name itself; case aside."""
    low, p = F.lower(name), pattern.strip().lower()
    if p.endswith("*"):
        return low.startswith(p[:-1])
    if p.startswith("@") and "/" not in p:
        return (low == p) | low.startswith(f"{p}/")
    return low == p


def source_policy(packages: DataFrame) -> DataFrame:
    """Packages from outside registries: git without a full commit, addresses, paths."""
    pinned = F.coalesce(F.col("source_rev").rlike("^[0-9a-fA-F]{40}$"), F.lit(False))
    rule = F.when((F.col("source_kind") == "git") & ~pinned, "SOURCE/UnpinnedGit").when(F.col("source_kind") == "url", "SOURCE/Url").when(F.col("source_kind") == "path", "SOURCE/Path")
    return packages.withColumn("rule", rule).where("rule is not null")


def registry_policy(packages: DataFrame, rules: list[tuple[str, str]], internal_names: list[str], public: str) -> DataFrame:
    """Packages under a registry rule that come from elsewhere, internal names from the public registry, and those whose registry isn't recorded (incomplete)."""
    url = F.lower(F.regexp_replace(F.coalesce("source_url", F.lit(public)), "/+$", ""))
    ruled = [(internal(F.col("name"), p), F.lower(F.lit(u.rstrip("/")))) for p, u in rules]
    own = F.lit(False)
    for p in internal_names:
        own = own | internal(F.col("name"), p)
    covered = own
    for t, _ in ruled:
        covered = covered | t
    unbound = covered & ~F.col("registry_recorded") & F.col("source_url").isNull()
    hits = [F.when(unbound, "unbound"), *(F.when(~unbound & t & (url != u), "REGISTRY/Mismatch") for t, u in ruled), F.when(~unbound & own & F.col("source_url").isNull(), "REGISTRY/DependencyConfusion")]
    return packages.where("source_kind = 'registry'").withColumn("rule", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))))


def missing_integrity(packages: DataFrame) -> DataFrame:
    """Lockfiles with registry packages without a hash: how many, and the first five."""
    rows = packages.where("source_kind = 'registry' and integrity is null and not member")
    first = F.row_number().over(Window.partitionBy("lockfile").orderBy("name", "version"))
    return rows.withColumn("at", first).groupBy("lockfile").agg(F.count("*").alias("missing"), F.array_sort(F.collect_set(F.when(F.col("at") <= 5, F.concat_ws("@", "name", "version")))).alias("samples"))


def name_guard(packages: DataFrame, min_age: int = 90, min_downloads: int = 1000) -> DataFrame:
    """packages with points and suspicion; a signal that the registry withheld keeps a name from being cleared."""
    c = F.col
    points = F.when(c("age_days") < min_age, 2).otherwise(0) + F.when(c("downloads") < min_downloads, 1).otherwise(0) + F.when(~c("has_repository"), 1).otherwise(0)
    unverified = c("age_days").isNull() | c("downloads").isNull()
    level = F.when(c("in_lockfile"), "low").when(~c("found"), "high").when((points == 0) & ~unverified, "low").when(points <= 2, "medium").otherwise("high")
    return packages.withColumn("points", points).withColumn("suspicion", level)


def plausible(name: Column, npm: bool = False) -> Column:
    segment = "[A-Za-z0-9._~-]+"
    shape = f"^(?:@{segment}/{segment}|{segment})$" if npm else f"^{segment}$"
    return (F.length(name) <= 214) & name.rlike(shape) & ~name.isin(".", "..")


def typosquats(names: DataFrame, popular: list[str], least: int = 5, distance: int = 2) -> DataFrame:
    """names with ``near``: the first popular name, in the list's order, within the edit distance; none for one that is itself popular.

    The list is a short constant, so it becomes an expression."""
    name = F.replace(F.lower("name"), F.lit("-"), F.lit("_"))
    near = F.lit(None).cast("string")
    for p in reversed(popular):
        q = p.lower().replace("-", "_")
        close = (F.length(name) >= least) & F.lit(len(q) >= least) & (F.levenshtein(name, F.lit(q), distance) >= 0)
        near = F.when(name == q, F.lit("")).when(close, F.lit(p)).otherwise(near)
    return names.withColumn("near", near).where("near <> ''")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.when(ecosystem == "npm", "npm").when(ecosystem == "PyPI", "pypi").when(ecosystem == "Go", "golang").otherwise("cargo")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "%", "%25"), "@", "%40"), " ", "%20")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), safe, F.lit("@"), F.regexp_replace(version, r"\+", "%2B"))


def components(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct components by purl with the sorted union of what they depend on."""
    left = packages.select(F.col("node").alias("src"), "purl").distinct()
    on = edges.join(left, "src").join(packages.select(F.col("node").alias("dst"), F.col("purl").alias("target")).distinct(), "dst").groupBy("purl").agg(F.array_sort(F.collect_set("target")).alias("depends_on"))
    return packages.select("purl").distinct().join(on, "purl", "left").select("purl", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def cyclonedx(bom: DataFrame) -> DataFrame:
    """A CycloneDX 1.5 document of components from ``components``."""
    rows = bom.agg(F.sort_array(F.collect_list(F.struct(F.col("purl").alias("ref"), F.col("depends_on").alias("dependsOn")))).alias("dependencies"))
    listed = F.transform("dependencies", lambda d: F.struct(F.lit("library").alias("type"), d["ref"].alias("bom-ref"), d["ref"].alias("purl")))
    return rows.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), listed.alias("components"), F.col("dependencies"))).alias("bom"))


def unplanned(installed: DataFrame, planned: DataFrame) -> DataFrame:
    """Installed packages that no plan has, unless the plan takes the name from outside registries."""
    return installed.join(planned.where("source_kind <> 'registry'").select("name"), "name", "left_anti").join(planned.select("name", "version"), ["name", "version"], "left_anti")


def cooldown_exempt(changes: DataFrame) -> DataFrame:
    """A young upgrade that fixes an advisory of the version it replaces is a warning, not a failure."""
    fixes = F.size(F.array_except("old_ids", "new_ids")) > 0
    return changes.withColumn("level", F.when((F.col("kind") == "Upgraded") & fixes, "warn").otherwise("fail"))
