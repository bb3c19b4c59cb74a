"""License names to SPDX expressions, and verdicts on expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Usual spellings of SPDX ids.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": ("mit", "mit license", "the mit license", "mit-license"),
    "ISC": ("isc", "isc license", "isc license (iscl)"),
    "Apache-2.0": ("apache-2.0", "apache 2.0", "apache 2", "apache license 2.0", "apache license, version 2.0", "apache software license", "apache-2"),
    "BSD-2-Clause": ("bsd-2-clause", "bsd 2-clause", "simplified bsd"),
    "BSD-3-Clause": ("bsd-3-clause", "bsd 3-clause", "new bsd", "new bsd license"),
    "MPL-2.0": ("mozilla public license 2.0 (mpl 2.0)", "mpl 2.0", "mpl-2.0"),
    "PSF-2.0": ("python software foundation license", "psf", "psf-2.0"),
    "Unlicense": ("the unlicense (unlicense)", "unlicense"),
    "Zlib": ("zlib", "zlib/libpng license"),
    "GPL-2.0": ("gnu general public license v2 (gplv2)",),
    "GPL-3.0": ("gnu general public license v3 (gplv3)",),
    "LGPL-3.0": ("gnu lesser general public license v3 (lgplv3)",),
    "AGPL-3.0": ("gnu affero general public license v3",),
}


def known(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for spdx, names in KNOWN.items():
        out = F.when(low.isin(*names), spdx).otherwise(out)
    return out


def normalize(raw: Column) -> Column:
    """An SPDX expression: slashes are alternatives (unless in an address), usual spellings become ids, else it must read as one."""
    text = F.trim(raw)
    text = F.when(text.contains("/") & ~text.contains("://"), F.regexp_replace(text, r"\s*/\s*", " OR ")).otherwise(text)
    parts = F.split(text, " OR ")
    ids = F.transform(parts, known)
    shape = r"^[()\s]*[A-Za-z][A-Za-z0-9.+:-]*[()\s]*(?:\s[()\s]*(?:AND|OR|WITH)\s[()\s]*[A-Za-z][A-Za-z0-9.+:-]*[()\s]*)*$"
    return F.when(F.forall(ids, lambda x: x.isNotNull()), F.array_join(ids, " OR ")).when(text.rlike(shape), text)


def parse(text: str) -> tuple | None:
    """('id', x), ('and', parts) or ('or', parts); WITH clauses are dropped; None for what can't be read."""
    words = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def level(joiner: str, below) -> tuple | None:
        nonlocal at
        parts = [below()]
        while at < len(words) and words[at] == joiner:
            at += 1
            parts.append(below())
        if None in parts:
            return None
        return parts[0] if len(parts) == 1 else (joiner.lower(), parts)

    def atom() -> tuple | None:
        nonlocal at
        if at >= len(words) or words[at] in ("AND", "OR", "WITH", ")"):
            return None
        word = words[at]
        at += 1
        if word == "(":
            inner = either()
            if at >= len(words) or words[at] != ")":
                return None
            at += 1
            return inner
        if at + 1 < len(words) and words[at] == "WITH":
            at += 2
        return ("id", word)

    def both() -> tuple | None:
        return level("AND", atom)

    def either() -> tuple | None:
        return level("OR", both)

    tree = either()
    return tree if at == len(words) else None


def _base(name: str) -> str:
    return re.sub(r"(-only|-or-later|\+)$", "", name.lower())


def judge(text: str | None, deny: list[str], allow: list[str]) -> tuple[str, list[str]]:
    """('allowed' | 'denied' | 'unknown', offending ids): of alternatives one must do, of conjuncts all."""
    tree = parse(text) if text else None
    if tree is None:
        return "unknown", []
    listed = lambda x, names: any(x.lower() == n.lower() or _base(x) == n.lower() for n in names)

    def bad(node: tuple) -> list[str]:
        if node[0] == "id":
            return [node[1]] if listed(node[1], deny) or (allow and not listed(node[1], allow)) else []
        each = [bad(p) for p in node[1]]
        if node[0] == "or" and not all(each):
            return []
        return [x for e in each for x in e]

    found = list(dict.fromkeys(bad(tree)))
    return ("denied", found) if found else ("allowed", [])


def verdict(expression: Column, deny: list[str], allow: list[str]) -> Column:
    """struct<verdict, ids> of an expression column."""

    @F.pandas_udf("verdict string, ids array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        from sievework.functions.licenses import judge

        return pd.DataFrame([judge(t, deny, allow) for t in texts], columns=["verdict", "ids"])

    return run(expression)
