"""Names, specifiers and digests as package managers write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import normal_name

# Digests that bills of materials know.
DIGESTS = {"sha1": "SHA-1", "sha256": "SHA-256", "sha384": "SHA-384", "sha512": "SHA-512"}


def pep508(requirement: Column) -> Column:
    """(name, spec) of a requirement; null where it is for an extra only, names an address, or has no name."""
    marker = F.regexp_extract(requirement, "(?s)^[^;]*;(.*)$", 1)
    bare = F.trim(F.regexp_extract(requirement, "(?s)^([^;]*)", 1))
    name = F.regexp_extract(bare, "^([A-Za-z0-9._-]*)", 1)
    rest = F.trim(F.regexp_replace(F.trim(F.substr(bare, F.length(name) + 1)), r"(?s)^\[[^\]]*\]", ""))
    spec = F.trim(F.regexp_replace(F.regexp_replace(rest, r"^\(+", ""), r"\)+$", ""))
    good = ~marker.contains("extra") & (name != "") & ~rest.startswith("@")
    return F.when(good, F.struct(normal_name(F.lit("PyPI"), name).alias("name"), spec.alias("spec")))


def npm_range(spec: Column) -> Column:
    """The range of an npm specifier: an alias keeps its own, any without one."""
    at = F.regexp_extract(spec, "^npm:.[^@]*@(.*)$", 1)
    return F.when(~spec.startswith("npm:"), spec).when(spec.rlike("^npm:.[^@]*@"), at).otherwise("*")


def integrity(value: Column) -> Column:
    """(alg, content) of the first digest of an integrity value, alg:hex or alg-base64 in either alphabet, as lower-case hex; null for others."""
    first = F.get(F.split(F.ltrim(value), r"\s+"), F.lit(0))
    colon = first.contains(":")
    name = F.lower(F.when(colon, F.substring_index(first, ":", 1)).otherwise(F.substring_index(first, "-", 1)))
    coded = F.translate(F.substr(first, F.length(name) + 2), "-_", "+/")
    content = F.when(colon, F.lower(F.substr(first, F.length(name) + 2))).otherwise(F.lower(F.hex(F.try_to_binary(coded, F.lit("base64")))))
    alg = F.lit(None).cast("string")
    for k, v in DIGESTS.items():
        alg = F.when(name == k, v).otherwise(alg)
    return F.when(alg.isNotNull() & content.isNotNull(), F.struct(alg.alias("alg"), content.alias("content")))


def percent(text: Column, slash: bool = False) -> Column:
    """Percent-encoded for a package address: letters, digits and .-_~ stand, and / where it parts a namespace."""
    keep = "^[A-Za-z0-9._~/-]$" if slash else "^[A-Za-z0-9._~-]$"
    coded = lambda c: F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(keep) | (c == ""), c).otherwise(coded(c))), "")


def purl(ecosystem: Column, name: Column, version: Column, source_kind: Column, url: Column, rev: Column) -> Column:
    """A package address with a qualifier where it isn't from the default registry."""
    kind = F.when(ecosystem == "npm", "npm").when(ecosystem == "PyPI", "pypi").when(ecosystem == "Go", "golang").otherwise("cargo")
    path = F.when(ecosystem.isin("npm", "Go"), percent(name, True)).otherwise(percent(normal_name(ecosystem, name)))
    at = F.when(version != "", F.concat(F.lit("@"), percent(version))).otherwise("")
    value = F.when(source_kind == "git", F.concat_ws("@", url, rev)).otherwise(url)
    key = F.when(source_kind == "git", "vcs_url").when(source_kind == "url", "download_url").when(source_kind == "registry", "repository_url")
    extra = F.when(key.isNotNull() & url.isNotNull(), F.concat(F.lit("?"), key, F.lit("="), percent(value))).otherwise("")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, at, extra)


def strict_date(text: Column) -> Column:
    """A date written as YYYY-MM-DD and nothing else; null for one that no calendar has."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
