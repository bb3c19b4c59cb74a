"""Advisory records and registry answers as relations, by schemas over JSON."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OSV = """id string, summary string, aliases array<string>, withdrawn string, database_specific struct<severity: string>, references array<struct<type: string, url: string>>,
affected array<struct<package: struct<ecosystem: string, name: string>, versions array<string>, ranges array<struct<type: string, events: array<map<string, string>>>>>>"""
OSV = OSV.replace("versions array<string>, ranges array", "versions: array<string>, ranges: array")


def osv_entries(records: DataFrame, column: str = "json") -> DataFrame:
    """One row an affected block: ecosystem, package_key, id, severity, reference, versions and ranges. Withdrawn records have none."""
    from ..functions.versions import normal_name

    r = records.select(F.from_json(column, OSV).alias("r")).where("r.id is not null and r.withdrawn is null").select("r.*", F.explode("r.affected").alias("a"))
    first = F.get(F.filter("references", lambda x: x["type"] == "ADVISORY"), F.lit(0))["url"]
    events = lambda e: F.flatten(F.transform(e, lambda m: F.transform(F.map_entries(m), lambda x: F.struct(x["key"].alias("kind"), x["value"].alias("version")))))
    ranges = F.transform(F.coalesce("a.ranges", F.array().cast("array<struct<type:string,events:array<map<string,string>>>>")), lambda x: F.struct(x["type"].alias("type"), events(x["events"]).alias("events")))
    return r.select(
        F.col("a.package.ecosystem").alias("ecosystem"), normal_name(F.col("a.package.ecosystem"), F.col("a.package.name")).alias("package_key"), "id", F.coalesce("summary", F.lit("")).alias("summary"),
        F.col("database_specific.severity").alias("severity"), F.coalesce(first, F.get("references", F.lit(0))["url"]).alias("reference"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"), ranges.alias("ranges"),
    )


#: Parts of a stored index of advisories.
SHARDS = 256


def shard_of(key):
    """The part of the index that holds a package: the first byte of its key's MD5."""
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(2)), 16, 10).cast("int") % SHARDS


def write_index(entries: DataFrame, root: str, version: int) -> None:
    """Store the entries of an index as a version of its own, a folder a shard. Readers see a version once it is whole."""
    rows = entries.withColumn("shard", shard_of(F.col("package_key")))
    # Packages spread over the tasks of their shard, so that a large ecosystem is no bottleneck.
    rows.repartition("shard", "package_key").sortWithinPartitions("shard", "package_key").write.mode("errorifexists").partitionBy("shard").parquet(f"{root.rstrip('/')}/version={version}")


def versions_of(spark, root: str) -> list[int]:
    """The versions of an index that are whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().removeprefix("version=")) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_index(spark, root: str, packages: list[str] | None = None) -> DataFrame:
    """The entries of the newest whole version; of packages named, only their shards are read."""
    versions = versions_of(spark, root)
    if not versions:
        raise FileNotFoundError(f"no whole version of an index in {root}")
    rows = spark.read.parquet(f"{root.rstrip('/')}/version={versions[-1]}")
    if packages is not None:
        shards = sorted({int(hashlib.md5(p.encode()).hexdigest()[:2], 16) % SHARDS for p in packages})
        rows = rows.where(F.col("shard").isin(*shards) & F.col("package_key").isin(*packages))
    return rows.drop("shard")


NPM = "time map<string,string>, versions map<string, struct<scripts: map<string,string>, gypfile: boolean, _npmUser: struct<name: string>, dist: struct<attestations: string>, deprecated: string, license: string, dependencies: map<string,string>>>"


def npm_releases(packuments: DataFrame, column: str = "json") -> DataFrame:
    """package, version, published, install_script, publisher, provenance, withdrawn, license and requires of every version."""
    r = packuments.select("package", F.from_json(column, NPM).alias("r")).select("package", "r.time", F.explode("r.versions").alias("version", "v"))
    hooks = F.array_intersect(F.map_keys(F.coalesce("v.scripts", F.create_map().cast("map<string,string>"))), F.array(*map(F.lit, ("preinstall", "install", "postinstall"))))
    return r.select(
        "package", "version", F.try_to_timestamp(F.element_at("time", F.col("version"))).alias("published"), ((F.size(hooks) > 0) | F.coalesce("v.gypfile", F.lit(False))).alias("install_script"), F.col("v._npmUser.name").alias("publisher"),
        F.col("v.dist.attestations").isNotNull().alias("provenance"), F.col("v.deprecated").alias("withdrawn"), F.col("v.license").alias("license"), F.col("v.dependencies").alias("requires"),
    )


PYPI = "info struct<license_expression: string, license: string, classifiers: array<string>>, releases map<string, array<struct<packagetype: string, upload_time_iso_8601: string, yanked: boolean, yanked_reason: string>>>"


def pypi_releases(projects: DataFrame, column: str = "json") -> DataFrame:
    """The same of PyPI projects: a version runs code at install time if it has no wheel, and is withdrawn if all its files are, for the first reason given. Versions without files are none.

    The licence is the project's: its expression, else all its licence classifiers, else what its text field says in one short line. Who published isn't told."""
    r = projects.select("package", F.from_json(column, PYPI).alias("r")).select("package", "r.info", F.explode("r.releases").alias("version", "files")).where(F.size("files") > 0)
    classifiers = F.transform(F.filter(F.coalesce("info.classifiers", F.array().cast("array<string>")), lambda c: c.startswith("License :: ")), lambda c: F.element_at(F.split(F.substring(c, 12, 1 << 20), " :: "), -1))
    text = F.trim("info.license")
    license_ = F.coalesce(F.nullif(F.trim("info.license_expression"), F.lit("")), F.when(F.size(classifiers) > 0, F.array_join(classifiers, " OR ")), F.when(F.octet_length(text).between(1, 80) & ~text.contains("\n"), text))
    reasons = F.filter(F.transform("files", lambda f: f["yanked_reason"]), lambda x: x.isNotNull() & (x != ""))
    return r.select(
        "package", "version", F.array_min(F.transform("files", lambda f: F.try_to_timestamp(f["upload_time_iso_8601"]))).alias("published"), (~F.exists("files", lambda f: F.coalesce(f["packagetype"] == "bdist_wheel", F.lit(False)))).alias("install_script"),
        F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("boolean").alias("provenance"), F.when(F.forall("files", lambda f: F.coalesce(f["yanked"], F.lit(False))), F.coalesce(F.get(reasons, F.lit(0)), F.lit("yanked"))).alias("withdrawn"),
        license_.alias("license"),
    )


CRATES = "versions array<struct<num: string, created_at: string, yanked: boolean, yank_message: string, published_by: struct<login: string>, trustpub_data: string, license: string>>"


def crate_releases(answers: DataFrame, column: str = "json") -> DataFrame:
    """The same of crates.io's answers: what code runs at build time only the sources tell; provenance is that of trusted publishing."""
    r = answers.select("package", F.explode(F.from_json(column, CRATES)["versions"]).alias("v"))
    return r.select(
        "package", F.col("v.num").alias("version"), F.try_to_timestamp("v.created_at").alias("published"), F.lit(None).cast("boolean").alias("install_script"), F.col("v.published_by.login").alias("publisher"),
        F.col("v.trustpub_data").isNotNull().alias("provenance"), F.when(F.col("v.yanked"), F.coalesce(F.nullif("v.yank_message", F.lit("")), F.lit("yanked"))).alias("withdrawn"), F.col("v.license").alias("license"),
    )


def index_requirements(lines: DataFrame, column: str = "value") -> DataFrame:
    """version, name and requirement of a crate index's JSON lines; yanked versions and development needs are left out."""
    schema = "vers string, deps array<struct<name: string, req: string, kind: string, package: string>>, yanked boolean"
    r = lines.select(F.from_json(column, schema).alias("r")).where("r.vers is not null and not coalesce(r.yanked, false)")
    return r.select(F.col("r.vers").alias("version"), F.explode("r.deps").alias("d")).where("coalesce(d.kind, 'normal') <> 'dev'").select("version", F.coalesce("d.package", "d.name").alias("name"), F.col("d.req").alias("requirement"))
