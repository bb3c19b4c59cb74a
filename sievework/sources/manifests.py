"""YAML documents, workflows and settings files."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship


def scalar(text: str):
    """A YAML scalar: quoted and plain strings, numbers, booleans and null; the trigger key ``on`` stays text."""
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text[:1] in "[{":
        return flow(text)
    text = re.sub(r"\s+#.*$", "", text)
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"-?[0-9]+\.[0-9]+", text):
        return float(text)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower() if text in ("", "~") or text.lower() in ("true", "false", "null") else "\0", text)


def flow(text: str):
    """[a, b] and {a: b} on one line."""
    body, parts, depth, start = text.strip()[1:-1], [], 0, 0
    for i, c in enumerate(body):
        depth += (c in "[{") - (c in "]}")
        if c == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    parts = [p for p in [*parts, body[start:]] if p.strip()]
    if text.strip()[0] == "[":
        return [scalar(p) for p in parts]
    return {k.strip().strip("\"'"): scalar(v) for k, _, v in (p.partition(":") for p in parts)}


def load(text: str):
    """The subset of YAML that manifests and workflows use: nested maps and lists by indent, block scalars, flow on one line."""
    rows = []
    for line in text.splitlines():
        bare = re.sub(r"^\s*#.*$", "", line).rstrip()
        rows.append((len(bare) - len(bare.lstrip()), bare.strip(), line))
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(rows) and not rows[at][1]:
            at += 1

    def block(parent: int, fold: bool) -> str:
        nonlocal at
        out = []
        while at < len(rows) and (not rows[at][2].strip() or len(rows[at][2]) - len(rows[at][2].lstrip()) > parent):
            out.append(rows[at][2].strip())
            at += 1
        return (" " if fold else "\n").join(out).strip()

    def value(rest: str, indent: int):
        nonlocal at
        if re.fullmatch(r"[|>][+-]?", rest):
            return block(indent, rest[0] == ">")
        if rest:
            return scalar(rest)
        skip()
        if at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("- "))):
            return node(rows[at][0])
        return None

    def node(indent: int):
        nonlocal at
        out = None
        while True:
            skip()
            if at >= len(rows) or rows[at][0] != indent:
                return out
            text = rows[at][1]
            if text.startswith("- ") or text == "-":
                if out is None:
                    out = []
                if not isinstance(out, list):
                    return out
                inner = text[1:].lstrip()
                if re.match(r"^(\"[^\"]*\"|'[^']*'|[^\s:\[{\"'][^:]*):(\s|$)", inner):
                    shift = indent + len(text) - len(inner)
                    rows[at] = (shift, inner, " " * shift + inner)
                    out.append(node(shift))
                else:
                    at += 1
                    out.append(value(inner, indent))
                continue
            m = re.match(r"^(\"[^\"]*\"|'[^']*'|[^:]+?):(?:\s+(.*))?$", text)
            if not m or isinstance(out, list):
                raise ValueError(f"line {at + 1}: {text[:60]}")
            out = {} if out is None else out
            at += 1
            out[m[1].strip("\"'")] = value((m[2] or "").strip(), indent)

    skip()
    found = node(rows[at][0]) if at < len(rows) else None
    skip()
    if at < len(rows):
        raise ValueError(f"line {at + 1}: {rows[at][1][:60]}")
    return found


def documents(files: DataFrame) -> DataFrame:
    """path, at, json and state ('ok', 'template', 'error') of every document of YAML files (path, text)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sievework.sources.manifests import load

        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                for i, part in enumerate(p for p in re.split(r"(?m)^\s*---\s*$", text or "") if p.strip()):
                    try:
                        rows.append((path, i, json.dumps(load(part)), "ok"))
                    except Exception:  # noqa: BLE001  any malformed document
                        rows.append((path, i, None, "template" if "{{" in part else "error"))
            yield pd.DataFrame(rows, columns=["path", "at", "json", "state"])

    return files.select("path", "text").mapInPandas(run, "path string, at int, json string, state string")


def privileged_checkouts(workflows: DataFrame) -> DataFrame:
    """path and job of workflows that run on pull_request_target and check out the head of the request, one row a job; workflows are path and json."""
    doc = F.parse_json("json")
    on = F.coalesce(F.to_json(F.try_variant_get(doc, "$.on", "variant")), F.lit(""))
    jobs = F.from_json(F.get_json_object("json", "$.jobs"), "map<string, struct<steps: array<struct<uses: string, with: struct<ref: string>>>>>")
    rows = workflows.where(on.rlike('"pull_request_target"')).select("path", F.explode(jobs).alias("job", "j"))
    unsafe = F.exists("j.steps", lambda s: F.coalesce(s["uses"].contains("checkout") & (s["with"]["ref"].contains("pull_request") | s["with"]["ref"].contains("head_ref")), F.lit(False)))
    return rows.where(unsafe).select("path", "job")


REQUIRED = ("id", "reason", "owner", "expires")
MATCHES = ("fingerprint", "rule", "path", "advisory", "package")


def exceptions(text: str) -> tuple[list[dict], list[str]]:
    """Rules of an exceptions file (TOML) and everything that is wrong with it."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return [], [str(e)]
    rules, errors, seen = [], [], set()
    for i, e in enumerate(doc.get("exception", [])):
        name = e.get("id", f"#{i + 1}")
        match = e.get("match", {})
        errors += [f"{name}: no {k}" for k in REQUIRED if not str(e.get(k, "")).strip()]
        errors += [f"{name}: unknown field {k}" for k in e if k not in (*REQUIRED, "match", "ticket")]
        errors += [f"{name}: unknown match {k}" for k in match if k not in MATCHES]
        if not match:
            errors.append(f"{name}: matches nothing")
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(e.get("expires", ""))):
            errors.append(f"{name}: expires is no date")
        if name in seen:
            errors.append(f"{name}: twice")
        seen.add(name)
        rules.append({"id": name, "reason": e.get("reason", ""), "owner": e.get("owner", ""), "expires": str(e.get("expires", "")), **{k: match[k] for k in match if k in MATCHES}})
    return rules, errors
