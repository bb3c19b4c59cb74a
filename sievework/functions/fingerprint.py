"""Keyed fingerprints of findings: HMAC-SHA256 from built-in digests, with the salt's pads as literals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(salt: bytes) -> tuple[str, str]:
    """Hex of the inner and outer pads of HMAC with a 64-byte block."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac(salt: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column."""
    inner, outer = pads(salt)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256))), 256)


def rule_key(rule: Column) -> Column:
    """Complexity rules carry a measurement, which must not count."""
    return F.when(rule.startswith("SMELL/"), F.regexp_extract(rule, r"^(.*?)(?: \(|$)", 1)).otherwise(rule)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def fingerprint(salt: bytes, rule: Column, path: Column, matched: Column, context: Column) -> Column:
    """32 hex digits over rule, path and the digests of what matched and its context."""
    zero = F.unhex(F.lit("00"))
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    return F.substring(hmac(salt, F.concat(rule.cast("binary"), zero, path.cast("binary"), zero, digest(matched), digest(context))), 1, 32)


def match_hash(salt: bytes, matched: Column) -> Column:
    """24 hex digits over what matched; '' where nothing did, as such findings cannot move."""
    return F.when(matched == "", "").otherwise(F.substring(hmac(salt, F.concat(F.lit("match\0").cast("binary"), matched.cast("binary"))), 1, 24))
