"""What a project's manifests (package.json, Cargo.toml, pyproject.toml) ask of a dependency.

A manifest becomes rows of requirements in the order in which they count; which of them holds is then a join and a minimum."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.names import pep508
from ..functions.versions import normal_name

# The tables of each kind of manifest, in the order in which they are looked up.
NPM = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
CARGO = ("dependencies", "dev-dependencies", "build-dependencies")
POETRY = ("dependencies", "dev-dependencies")
ROW = "path string, member string, at int, name string, key string, spec string, syntax string, of string"


def _table(of, *keys: str) -> dict:
    for k in keys:
        of = of.get(k) if isinstance(of, dict) else None
    return of if isinstance(of, dict) else {}


def _text(value, default: str | None = None) -> str | None:
    """A requirement, or the version of one with more to it."""
    if isinstance(value, str):
        return value
    version = value.get("version") if isinstance(value, dict) else None
    return version if isinstance(version, str) else default


def _npm(doc: dict) -> Iterator[tuple]:
    for table in NPM:
        for name, spec in _table(doc, table).items():
            if isinstance(spec, str):
                yield name, name, spec, "native", "own"


def _cargo(doc: dict) -> Iterator[tuple]:
    for key, value in _table(doc, "workspace", "dependencies").items():
        yield key, key, _text(value), "native", "workspace"
    places = [doc, *(t for t in _table(doc, "target").values() if isinstance(t, dict))]
    for key, value in ((k, v) for p in places for t in CARGO for k, v in sorted(_table(p, t).items())):
        more = value if isinstance(value, dict) else {}
        inherits = more.get("workspace") is True
        yield more.get("package", key), key, None if inherits else _text(value, "*"), "native", "inherited" if inherits else "own"


def _python(doc: dict) -> Iterator[tuple]:
    lists = [_table(doc, "project").get("dependencies"), *_table(doc, "project", "optional-dependencies").values(), *_table(doc, "dependency-groups").values()]
    for r in (r for one in lists if isinstance(one, list) for r in one if isinstance(r, str)):
        yield None, None, r, "pep508", "own"
    poetry = _table(doc, "tool", "poetry")
    for table in [*(_table(poetry, t) for t in POETRY), *(_table(g, "dependencies") for g in _table(poetry, "group").values())]:
        for name, value in sorted(table.items()):
            yield name, name, _text(value, "*"), "poetry", "own"


def read(path: str, text: str) -> list[tuple]:
    """(path, member, at, name, key, spec, syntax, of) of a manifest's requirements; ``of`` tells the project's own from those that it inherits and from the workspace's."""
    kind = path.rsplit("/", 1)[-1]
    try:
        doc = json.loads(text) if kind == "package.json" else tomllib.loads(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(doc, dict):
        return []
    rows = {"package.json": _npm, "Cargo.toml": _cargo, "pyproject.toml": _python}[kind](doc)
    member = _table(doc, "package").get("name") if kind == "Cargo.toml" else None
    # A manifest without requirements is still there.
    return [(path, member, i, *r) for i, r in enumerate([*rows, (None, None, None, None, "none")])]


def declared(files: DataFrame) -> DataFrame:
    """The rows of ``read`` for the manifests among files (path, text); Python's names are normal ones, and its requirements without their marks."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sievework.sources.requirements import ROW, read

        columns = [c.split()[0] for c in ROW.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"], strict=True) if t is not None for r in read(p, t)], columns=columns)

    rows = files.where(F.col("path").rlike(r"(?:^|/)(?:package\.json|Cargo\.toml|pyproject\.toml)$")).select("path", "text").mapInPandas(run, ROW)
    rows = rows.withColumn("p", F.when(F.col("syntax") == "pep508", pep508(F.col("spec"))))
    name = F.when(F.col("syntax") == "pep508", F.col("p.name")).when(F.col("syntax") == "poetry", normal_name(F.lit("PyPI"), F.col("name"))).otherwise(F.col("name"))
    return rows.select("path", "member", "at", name.alias("name"), "key", F.when(F.col("syntax") == "pep508", F.col("p.spec")).otherwise(F.col("spec")).alias("spec"), "syntax", "of")


def requirements(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked (dir of the lockfile, ecosystem, member, at: the member's folder from there, name) with ``requirement`` and ``syntax``; both null where no manifest names the dependency.

    A crate's member is the manifest of that name beside the lockfile, else one below it. Go modules ask for nothing but what is locked."""
    under = lambda d, rest: F.when(d == "", rest).otherwise(F.concat(d, F.lit("/"), rest))
    keys = ["dir", "ecosystem", "member", "at", "name"]
    rows = asked.select(*keys).distinct()
    want = rows.withColumns({"folder": F.when(F.col("at").isin("", "."), F.col("dir")).otherwise(under(F.col("dir"), F.col("at"))), "want": normal_name(F.col("ecosystem"), F.col("name"))})
    file = F.when(F.col("ecosystem") == "npm", "package.json").when(F.col("ecosystem") == "PyPI", "pyproject.toml")
    own = found.where("of = 'own' or of = 'inherited'").withColumnRenamed("name", "want").withColumnRenamed("at", "place")
    plain = want.where(F.col("ecosystem").isin("npm", "PyPI")).withColumn("path", under(F.col("folder"), file))
    plain = plain.join(own.select("path", "want", "place", "spec", "syntax"), ["path", "want"])
    crates = found.where("member is not null").select("member", "path").distinct()
    beside = under(F.col("dir"), F.lit("Cargo.toml"))
    below = (F.col("path") == beside) | (F.col("path").startswith(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/")))) & ~F.col("path").rlike(r"(?:^|/)(?:target|\.git|node_modules)/"))
    homes = want.where("ecosystem = 'crates.io'").join(crates, "member").where(below)
    homes = homes.groupBy(*keys, "want").agg(F.min_by("path", F.struct((F.col("path") != beside).alias("far"), F.col("path"))).alias("path"))
    crate = homes.join(own.select("path", "want", "place", "key", "spec", "syntax", "of"), ["path", "want"])
    root = found.where("of = 'workspace'").select(F.col("path").alias("root"), "key", F.col("spec").alias("shared"))
    crate = crate.withColumn("root", beside).join(root, ["root", "key"], "left").withColumn("spec", F.when(F.col("of") == "inherited", F.col("shared")).otherwise(F.col("spec")))
    first = plain.select(*keys, "place", "spec", "syntax").unionByName(crate.select(*keys, "place", "spec", "syntax")).groupBy(*keys).agg(F.min_by(F.struct("spec", "syntax"), "place").alias("first"))
    got = rows.join(first, keys, "left")
    go = F.col("ecosystem") == "Go"
    spec, syntax = F.when(go, "").otherwise(F.col("first.spec")), F.when(go, "native").otherwise(F.when(F.col("first.syntax") == "poetry", "poetry").when(F.col("first.spec").isNotNull(), "native"))
    return asked.join(got.select(*keys, spec.alias("requirement"), F.when(spec.isNotNull(), syntax).alias("syntax")), keys, "left")
