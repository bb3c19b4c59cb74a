"""Lockfiles of twelve formats as packages and edges, written from the public formats.

A file's grammar (JSON, TOML, YAML-like) has no row form, so one Python call reads it, entry by entry: besides the text it holds a few entries, and the rows as Arrow columns until the file has
proved to be whole. A text may come in parts that no task holds together before that."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from itertools import batched, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import parts, ship, spread

PACKAGE = "lockfile string, format string, ecosystem string, idx int, name string, version string, scope string, source_kind string, source_url string, source_rev string, integrity string, member boolean, requires array<string>, error string"
FORMATS = {
    "package-lock.json": "PackageLock", "npm-shrinkwrap.json": "PackageLock", "pnpm-lock.yaml": "Pnpm", "yarn.lock": "Yarn", "bun.lock": "Bun", "Cargo.lock": "CargoLock", "uv.lock": "UvLock",
    "poetry.lock": "PoetryLock", "pylock.toml": "Pylock", "requirements.txt": "Requirements", "go.mod": "GoMod", "go.sum": "GoSum",
}
ECOSYSTEM = {"PackageLock": "npm", "Pnpm": "npm", "Yarn": "npm", "Bun": "npm", "CargoLock": "crates.io", "GoMod": "Go", "GoSum": "Go"}


def format_of(path: str) -> str | None:
    return FORMATS.get(path.rsplit("/", 1)[-1])


def _row(name, version, source="registry", url=None, rev=None, integrity=None, member=False, scope="prod", requires=()):
    return {"name": name, "version": version, "scope": scope, "source_kind": source, "source_url": url, "source_rev": rev, "integrity": integrity, "member": member, "requires": sorted(set(requires))}


def _located(url: str | None) -> tuple[str, str | None, str | None]:
    """(kind, address, revision) of where a package comes from."""
    if not url:
        return "registry", None, None
    if url.startswith(("git+", "git:", "git@", "github:")) or ".git#" in url:
        base, _, rev = url.partition("#")
        return "git", base, rev or None
    if url.startswith(("file:", "link:", "workspace:", ".", "/")):
        return "path", url, None
    if m := re.match(r"^(https?://[^/]+)/.+\.t(?:ar\.)?gz", url):
        return ("url", url, None) if re.search(r"codeload|/archive/", url) else ("registry", m[1], None)
    return "url", url, None


class _Odd(Exception):
    """A text that isn't read entry by entry, or may not be."""


_JSON, _SPACE = json.JSONDecoder(), re.compile(r"[ \t\n\r]*")
#: Lines, letters and rows that are taken at once.
BLOCKS, LETTERS, ROWS = 64, 65536, 5000


def _pairs(text: str, i: int) -> Iterator[tuple[str, int]]:
    """Keys of the JSON object that begins at i, and where their values do; the receiver sends back where they end. The last one has no key, and says where the object ends."""
    at = lambda i: _SPACE.match(text, i).end()
    if text[i : i + 1] != "{":
        raise _Odd
    i = at(i + 1)
    while text[i : i + 1] != "}":
        if text[i : i + 1] != '"':
            raise _Odd
        key, i = json.decoder.scanstring(text, i + 1)
        i = at(i)
        if text[i : i + 1] != ":":
            raise _Odd
        i = at((yield key, at(i + 1)))
        if text[i : i + 1] == ",":
            i = at(i + 1)
            if text[i : i + 1] == "}":
                raise _Odd
        elif text[i : i + 1] != "}":
            raise _Odd
    yield None, i + 1


def _value(text: str, i: int) -> tuple[object, int]:
    try:
        return _JSON.scan_once(text, i)
    except StopIteration:
        raise _Odd from None


def _json_packages(text: str, whole: bool) -> Iterator[tuple[str, object]]:
    """The members of a document's packages."""
    if whole:
        yield from json.loads(text).get("packages", {}).items()
        return
    outer, met = _pairs(text, _SPACE.match(text, 0).end()), False
    key, i = next(outer)
    while key is not None:
        if key != "packages":
            end = _value(text, i)[1]
        elif met:
            raise _Odd
        else:
            met, seen, inner = True, set(), _pairs(text, i)
            name, i = next(inner)
            while name is not None:
                if (h := hash(name)) in seen:
                    raise _Odd
                seen.add(h)
                value, end = _value(text, i)
                yield name, value
                name, i = inner.send(end)
            end = i
        key, i = outer.send(end)
    if _SPACE.match(text, i).end() < len(text):
        raise _Odd


def _toml_packages(text: str, name: str, whole: bool) -> Iterator[dict]:
    """The tables of a document's array of this name. What lies between some of its headings is a document itself; what else these hold may not meet."""
    if whole:
        yield from tomllib.loads(text).get(name, [])
        return
    others: set[str] = set()
    for i, j in _cuts(text, rf"(?m)^\[\[{name}\]\]"):
        doc = tomllib.loads(text[i:j])
        if i == 0 and j < len(text) and name in doc and not text.startswith("[["):
            raise _Odd
        own = doc.pop(name, [])
        if not others.isdisjoint(doc) or not isinstance(own, list):
            raise _Odd
        others.update(doc)
        yield from own


def _cuts(text: str, heads: str) -> Iterator[tuple[int, int]]:
    """Where parts of a text begin and end: what lies before the first heading, and then BLOCKS of them each."""
    i = 0
    for k, m in enumerate(re.finditer(heads, text)):
        if k % BLOCKS == 0 and m.start() > i:
            yield i, m.start()
            i = m.start()
    yield i, len(text)


def _pieces(text: str, ends: str) -> Iterator[str]:
    """What lies between the matches of a pattern."""
    i = 0
    for m in re.finditer(ends, text):
        yield text[i : m.start()]
        i = m.end()
    yield text[i:]


def _lines(text: str) -> Iterator[str]:
    i = 0
    while i < len(text):
        j = text.find("\n", i + LETTERS) + 1 or len(text)
        yield from text[i:j].splitlines()
        i = j


def package_lock(text: str, whole: bool = False) -> Iterator[dict]:
    for path, p in _json_packages(text, whole):
        name = p.get("name") or path.rsplit("node_modules/", 1)[-1]
        member = "node_modules/" not in path
        kind, url, rev = ("path", p.get("resolved"), None) if p.get("link") else _located(p.get("resolved"))
        scope = "dev" if p.get("dev") else "optional" if p.get("optional") else "prod"
        yield _row(name, p.get("version", ""), kind, url, rev, p.get("integrity"), member, scope, [*p.get("dependencies", {}), *p.get("optionalDependencies", {})])


def pnpm(text: str, whole: bool = False) -> Iterator[dict]:
    section, current = "", None
    for line in _lines(text):
        if m := re.match(r"^([a-zA-Z]+):", line):
            if current:
                yield current
            section, current = m[1], None
        elif section == "packages" and (m := re.match(r"^  '?/?(@?[^@'\s]+)@([^:'(\s]+)[^:]*'?:", line)):
            if current:
                yield current
            current = _row(m[1], m[2])
        elif current and (m := re.match(r"^    resolution: \{(.*)\}", line)):
            fields = dict(re.findall(r"(\w+): '?([^,'}]+)'?", m[1]))
            current["integrity"] = fields.get("integrity")
            if "tarball" in fields:
                current["source_kind"], current["source_url"], current["source_rev"] = _located(fields["tarball"])
            if "commit" in fields:
                current["source_kind"], current["source_url"], current["source_rev"] = "git", fields.get("repo"), fields["commit"]
        elif current and re.match(r"^    dev: true", line):
            current["scope"] = "dev"
    if current:
        yield current


def yarn(text: str, whole: bool = False) -> Iterator[dict]:
    berry = "__metadata:" in text
    for block in _pieces(text, r"\n(?=\S)"):
        lines = block.splitlines()
        if not lines or lines[0].startswith("#") or not lines[0].rstrip().endswith(":") or lines[0].startswith("__"):
            continue
        spec = lines[0].strip().rstrip(":").split(",")[0].strip().strip('"')
        name, _, wanted = spec[1:].partition("@") if spec.startswith("@") else spec.partition("@")
        name = f"@{name}" if spec.startswith("@") else name
        fields = {m[1]: m[2] for x in lines if (m := re.match(r'^  "?([A-Za-z]+)"?:? "?([^"\s]+)"?', x))}
        needs, inside = [], False
        for x in lines:
            if re.match(r"^  (dependencies|optionalDependencies):", x):
                inside = True
            elif inside and (m := re.match(r'^    "?(@?[^"\s:]+)"?:? ', x)):
                needs.append(m[1])
            elif not x.startswith("    "):
                inside = False
        if berry:
            member = "@workspace:" in spec or "@workspace:" in fields.get("resolution", "")
            kind, url, rev = ("path", None, None) if member else ("registry", None, None) if wanted.startswith("npm:") else _located(wanted)
            yield _row(name, fields.get("version", ""), kind, url, rev, fields.get("checksum"), member, requires=needs)
        else:
            kind, url, rev = _located(fields.get("resolved"))
            yield _row(name, fields.get("version", ""), kind, url, rev, fields.get("integrity"), requires=needs)


def bun(text: str, whole: bool = False) -> Iterator[dict]:
    for key, p in _json_packages(re.sub(r",(\s*[}\]])", r"\1", text), whole):
        name, _, version = p[0].rpartition("@")
        meta = next((x for x in p[1:] if isinstance(x, dict)), {})
        kind, url, rev = _located(version) if re.match(r"^[a-z]+[:+]|^[./]", version) else ("registry", None, None)
        yield _row(name or key, version, kind, url, rev, p[-1] if isinstance(p[-1], str) and "-" in p[-1] and len(p) > 2 else None, version.startswith("workspace:"), requires=meta.get("dependencies", {}))


def cargo_lock(text: str, whole: bool = False) -> Iterator[dict]:
    for p in _toml_packages(text, "package", whole):
        source = p.get("source", "")
        kind = "git" if source.startswith("git+") else "registry" if source else "path"
        url, _, rev = source.removeprefix("git+").removeprefix("registry+").removeprefix("sparse+").partition("#")
        yield _row(p["name"], p["version"], kind, url or None, rev or None, p.get("checksum"), not source, requires=[d.split(" ")[0] for d in p.get("dependencies", [])])


def python_lock(text: str, whole: bool = False) -> Iterator[dict]:
    """uv, Poetry and pylock files."""
    if whole:
        doc = tomllib.loads(text)
        found = doc.get("package") or doc.get("packages", [])
    else:
        named = re.search(r"(?m)^\[\[(packages?)\]\]", text)
        if not named or (named[1] == "packages" and re.search(r"(?m)^[ \t]*\[*[ \t]*[\"']?package\b", text)):
            raise _Odd
        found = _toml_packages(text, named[1], False)
    for p in found:
        source = p.get("source", {})
        kind, url, rev = "registry", source.get("registry") or p.get("index") or (source.get("url") if source.get("type") == "legacy" else None), None
        if "git" in source or source.get("type") == "git" or "vcs" in p:
            at = p.get("vcs", {})
            base = source.get("git") or source.get("url") or at.get("url", "")
            kind, url, rev = "git", base.partition("#")[0], source.get("resolved_reference") or at.get("commit-id") or base.partition("#")[2] or None
        elif source.get("url") and source.get("type") in (None, "url") and not source.get("registry"):
            kind, url = "url", source["url"]
        elif any(k in source for k in ("path", "directory", "editable", "virtual")) or source.get("type") in ("directory", "file") or "directory" in p:
            kind, url = "path", None
        member = any(k in source for k in ("editable", "virtual"))
        files = [*p.get("wheels", []), *([p["sdist"]] if p.get("sdist") else []), *p.get("files", [])]
        found = next((f.get("hash") or next((f"{a}:{h}" for a, h in f.get("hashes", {}).items()), None) for f in files), None)
        needs = p.get("dependencies", {})
        scope = "optional" if p.get("optional") else "dev" if p.get("category") == "dev" else "prod"
        yield _row(p["name"], p.get("version", ""), kind, url, rev, found, member, scope, [d["name"] if isinstance(d, dict) else d for d in needs])


def requirements(text: str, whole: bool = False) -> Iterator[dict]:
    for line in _lines(re.sub(r"\\\r?\n", " ", text)):
        if m := re.match(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^]]*\])?\s*==\s*([^\s;]+)", line):
            found = re.search(r"--hash=(\S+)", line)
            yield _row(m[1], m[2], integrity=found[1] if found else None)
        elif m := re.match(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^]]*\])?\s*@\s*(\S+)", line):
            kind = "git" if m[2].startswith("git+") else "path" if m[2].startswith("file:") else "url"
            yield _row(m[1], "", kind, m[2], m[2].rpartition("@")[2] if kind == "git" and m[2].count("@") else None)


def go_mod(text: str, whole: bool = False) -> Iterator[dict]:
    text = re.sub(r"(?m)^\s*//.*$", "", text)
    replaced = {m[1]: (m[2], m[3]) for m in re.finditer(r"(?m)^(?:replace\s+|\s+)(\S+)(?:\s+v\S+)?\s+=>\s+(\S+)(?:\s+(v\S+))?", text)}
    if m := re.search(r"(?m)^module\s+(\S+)", text):
        yield _row(m[1], "", "path", member=True)
    for m in re.finditer(r"(?m)^(?:require\s+|\s+)(\S+)\s+(v\S+)[ \t]*(// indirect)?$", text):
        name, version = replaced.get(m[1], (m[1], m[2]))
        kind = "path" if name.startswith((".", "/")) else "registry"
        yield _row(m[1] if kind == "path" else name, version or m[2], kind, name if kind == "path" else None, scope="indirect" if m[3] else "prod")


def go_sum(text: str, whole: bool = False) -> Iterator[dict]:
    for line in _lines(text):
        parts = line.split()
        if len(parts) == 3 and not parts[1].endswith("/go.mod"):
            yield _row(parts[0], parts[1], integrity=parts[2])


PARSERS = {
    "PackageLock": package_lock, "Pnpm": pnpm, "Yarn": yarn, "Bun": bun, "CargoLock": cargo_lock, "UvLock": python_lock, "PoetryLock": python_lock, "Pylock": python_lock, "Requirements": requirements,
    "GoMod": go_mod, "GoSum": go_sum,
}


def _parse(path: str, text: str, take) -> list:
    """What take makes of each ROWS rows of a lockfile's packages; of one row with an error for what can't be read, as that is no pass.
    A file that isn't read entry by entry is read whole, which also tells its error."""
    kind = format_of(path)
    base = {"lockfile": path, "format": kind, "ecosystem": ECOSYSTEM.get(kind, "PyPI"), "error": None}
    for whole in (False, True):
        try:
            return [take([{**base, "idx": i, **r} for i, r in some]) for some in batched(enumerate(PARSERS[kind](text, whole)), ROWS)]
        except Exception as e:  # noqa: BLE001  any malformed file
            error = f"{type(e).__name__}: {e}"[:300]
    return [take([{**base, "idx": -1, **_row(None, None), "error": error}])]


def parse(path: str, text: str) -> list[dict]:
    """Rows of a lockfile's packages."""
    return [r for some in _parse(path, text, list) for r in some]


COLUMNS = [c.split()[0] for c in PACKAGE.split(", ")]
_TYPES = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in PACKAGE.split(", ")])
_SMALL = pa.ipc.IpcWriteOptions(compression="lz4" if pa.Codec.is_available("lz4") else None)
#: Bytes of a text that go to Python in a row: Arrow's batches are counted in rows, so larger ones would make large batches in each task.
BYTES = 1024


def _packed(rows: list[dict]) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCHEMA, options=_SMALL) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in SCHEMA], schema=SCHEMA))
    return sink.getvalue()


def batches(path: str, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of parse as Arrow batches, once the file has been read to its end; until then they are held compressed."""
    for some in _parse(path, text, _packed):
        yield from pa.ipc.open_stream(some)


def packages(files: DataFrame, part: str | None = None) -> DataFrame:
    """One row a package of every lockfile among the files (path, text). part: a column by whose order the texts of one path are the parts of one file."""
    ship(files.sparkSession)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.sources.lockfiles import batches

        def text() -> str:
            whole = held.decode("utf-8", "replace")
            held.clear()
            return whole

        before, held = None, bytearray()
        for b in given:
            files = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            starts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]]
            for i, j in pairwise((*starts, len(files))):
                if files[i] != before:
                    if before is not None:
                        yield from batches(before[0], text())
                    before = files[i]
                held += b"".join(b.column(2).slice(i, j - i).to_pylist())
        if before is not None:
            yield from batches(before[0], text())

    known, raw = files.where(F.substring_index("path", "/", -1).isin(*FORMATS)), F.coalesce("text", F.lit("")).cast("binary")
    if part is None:
        dealt = spread(known.select("path", "text")).select("path", F.monotonically_increasing_id().alias("file"), raw.alias("raw"))
    else:
        dealt = known.repartition(parts(files.sparkSession), "path").sortWithinPartitions("path", part).select("path", F.lit(0).cast("long").alias("file"), raw.alias("raw"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("raw") - 1, F.lit(0)) / BYTES).cast("int")), lambda i: F.substring("raw", i * BYTES + 1, F.lit(BYTES)))
    return dealt.select("path", "file", F.explode(cut).alias("raw")).mapInArrow(run, PACKAGE)


def edges(found: DataFrame) -> DataFrame:
    """lockfile, src and dst of packages that require one another by name."""
    needs = found.select("lockfile", F.col("idx").alias("src"), F.explode("requires").alias("name"))
    return needs.join(found.select("lockfile", F.col("idx").alias("dst"), "name"), ["lockfile", "name"]).select("lockfile", "src", "dst")
