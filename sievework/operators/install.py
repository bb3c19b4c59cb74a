"""Decisions about installs, as queries over what was planned, fetched, scanned and seen on disk. Nothing is installed here.

Every rule gives rows of ``rule``, ``severity`` and ``blocks``: a finding that holds the install back, or a warning that doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import settled, ship, spread
from . import lint as N
from . import shell

# What Python files hold that reach for a shell, the network, secrets or hidden code.
PYTHON_SIGNALS = (
    "eval(", "exec(", "compile(", "__import__(",
    "subprocess", "os.system(", "os.popen(", "os.execv(", "popen(",
    "socket.connect", "urllib.request", "http.client", "requests.get", "requests.post", "httplib", "ftplib",
    "base64.b64decode", "codecs.decode", "binascii.unhexlify", "zlib.decompress",
    "os.environ", "open('/etc/passwd')", 'open("/etc/passwd")', "open('/etc/shadow')",
    "curl ", "wget ",
)
# The same of Rust build scripts, and the part of them that ordinary build scripts never need.
BUILD_SIGNALS = (
    "TcpStream::connect", "UdpSocket::bind", "reqwest", "ureq::", "attohttpc", "minreq",
    "Command::new", "process::Command", "std::process::Command",
    "fs::write(", "File::create(", "OpenOptions::new()",
    "env::var(", "env::vars()", "std::env::var(",
    "sh -c", "bash -c", "powershell", "curl ", "wget ",
    "base64::decode", "from_utf8_unchecked",
    "libloading", "dlopen(",
)
STRONG_BUILD_SIGNALS = (
    "TcpStream::connect", "UdpSocket::bind", "reqwest", "ureq::", "attohttpc", "minreq",
    "sh -c", "bash -c", "powershell", "curl ", "wget ", "base64::decode", "libloading", "dlopen(",
)
SIGNALS = {"javascript": N.SCRIPT_SIGNALS, "python": PYTHON_SIGNALS, "build": BUILD_SIGNALS, "build-strong": STRONG_BUILD_SIGNALS}
# Fixed value: hooks that run on install.
HOOKS = ("preinstall", "install", "postinstall")
OUTSIDE = "reaches outside its package (../)"


def signals(text: Column, kind: str) -> Column:
    """The needles of a kind of script that the text holds, in the list's order."""
    return F.filter(F.array(*map(F.lit, SIGNALS[kind])), lambda s: F.contains(text, s))


def _verdict(df: DataFrame, rule: Column | str, severity: Column | str, blocks: Column | bool) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.withColumns({"rule": lit(rule), "severity": lit(severity), "blocks": lit(blocks)})


def not_allowed_builds(scripts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Packages with install scripts that the manager's own policy doesn't build: a warning, as they won't run."""
    return _verdict(scripts.join(allowed.select("name").distinct(), "name", "left_anti"), "INSTALL/BuildNotAllowed", "low", False)


def script_verdicts(scripts: DataFrame) -> DataFrame:
    """scripts (suspicious, scripts_off, allowlisted, isolated, one_step) with rule, severity, blocks and approved. Clean scripts run; suspicious ones
    run where they are allowlisted or kept apart, which a manager that builds all packages in one step can't do."""
    c = F.col
    apart = c("allowlisted") | (c("isolated") & ~c("one_step"))
    blocks = c("suspicious") & ~c("scripts_off") & ~apart
    rows = _verdict(scripts, F.when(c("suspicious"), "INSTALL/SuspiciousScript"), F.when(blocks, "high").when(c("suspicious"), "medium"), blocks)
    return rows.withColumn("approved", ~blocks)


def changes(before: DataFrame, after: DataFrame, state: list[str]) -> DataFrame:
    """path and what: created, modified (any of the state's columns differs) or deleted, between two snapshots."""
    old, new = (df.select("path", F.struct(*state).alias(n)) for df, n in ((before, "old"), (after, "new")))
    what = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return old.join(new, "path", "full_outer").select("path", what.alias("what")).where("what is not null")


def foreign_writes(found: DataFrame, own: Column) -> DataFrame:
    """Of a script's changes (package, path, what) the kinds with any outside its own folders, which ``own`` tells; how many, and the first five."""
    rows = found.where(~own)
    at = F.row_number().over(Window.partitionBy("package", "what").orderBy("path"))
    few = F.array_sort(F.collect_set(F.when(F.col("at") <= 5, F.col("path"))))
    return _verdict(rows.withColumn("at", at).groupBy("package", "what").agg(F.count("*").alias("files"), few.alias("samples")), "INSTALL/ForeignWrite", "high", True)


def vanished(events: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phantoms, checks): paths that a script created (events: package, path, kind) and that are gone, and packages whose watcher lost events: incomplete.

    Where what is there after (path) states packages, a file of one package doesn't stand for another's of the same path."""
    own = ["package", "path"] if "package" in after.columns else ["path"]
    lost = events.where("kind = 'overflow'").select("package").distinct()
    gone = events.where("kind = 'create'").select("package", "path").distinct().join(after.select(*own).distinct(), own, "left_anti").join(lost, "package", "left_anti").select("package", "path")
    return _verdict(gone, "INSTALL/PhantomFile", "high", True), lost.withColumn("status", F.lit("incomplete"))


def hash_rules(artifacts: DataFrame) -> DataFrame:
    """artifacts (content binary, sha256) whose bytes aren't what the index published, or for which it published nothing to compare with."""
    wrong = F.lower("sha256") != F.sha2("content", 256)
    rule = F.when(F.col("sha256").isNull(), "INSTALL/NoHash").when(wrong, "INSTALL/HashMismatch")
    return _verdict(artifacts, rule, F.when(wrong, "high").otherwise("medium"), F.coalesce(wrong, F.lit(False))).where("rule is not null")


def source_builds(items: DataFrame) -> DataFrame:
    """One warning a project whose plan ran the build code of source distributions without isolation."""
    built = items.where("kind = 'sdist' and not isolated").groupBy("project").agg(F.array_sort(F.collect_set(F.concat_ws("==", "name", "version"))).alias("items"))
    return _verdict(built, "INSTALL/SourceBuild", "medium", False)


def source_permissions(setups: DataFrame) -> DataFrame:
    """setups (text, isolated, allowlisted) with signals, verdict and ``may_build``: a suspicious setup script builds only apart or allowlisted."""
    found = signals(F.coalesce("text", F.lit("")), "python")
    rows = setups.withColumns({"signals": found, "blob": N.longest_blob(F.coalesce("text", F.lit("")))})
    bad = (F.size("signals") > 0) | F.col("blob").isNotNull()
    stop = bad & ~F.col("isolated") & ~F.col("allowlisted")
    return _verdict(rows, F.when(bad, "INSTALL/SuspiciousScript"), F.when(stop, "high").when(bad, "medium"), stop).withColumn("may_build", ~stop)


def startup_code(lines: DataFrame) -> DataFrame:
    """Executable lines of startup files (content, allowlisted) that hold a signal: import lines run at every start of the interpreter."""
    runs = F.col("content").rlike(r"^import[ \t]")
    rows = lines.where(runs).withColumn("signals", signals(F.col("content"), "python")).where(F.size("signals") > 0)
    return _verdict(rows, "INSTALL/StartupCode", F.when(F.col("allowlisted"), "medium").otherwise("high"), ~F.col("allowlisted"))


def blocked_writes(log: DataFrame) -> DataFrame:
    """Log lines of a sandboxed build (content) that tell of a refused write."""
    return _verdict(log.where(F.col("content").rlike(r"Read-only file system|Errno 30|EROFS")), "INSTALL/BlockedWrite", "high", True)


def build_scripts(sources: DataFrame) -> DataFrame:
    """Build scripts (text, allowlisted) with a strong signal or an encoded blob; spawning a compiler or writing output is what they are for."""
    rows = sources.withColumns({"signals": signals(F.coalesce("text", F.lit("")), "build-strong"), "blob": N.longest_blob(F.coalesce("text", F.lit("")))})
    bad = rows.where((F.size("signals") > 0) | F.col("blob").isNotNull())
    return _verdict(bad, "INSTALL/SuspiciousBuildScript", F.when(F.col("allowlisted"), "medium").otherwise("high"), ~F.col("allowlisted"))


def helper_files(command: Column) -> Column:
    """Files of its own package that a hook's command runs."""
    words = F.transform(F.split(command, r"[\s;&|()]+"), lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", ""))
    return F.filter(words, lambda w: (w != "") & ~w.startswith("-") & (w.startswith("./") | w.rlike(r"\.(?:js|cjs|mjs|sh|py)$")))


def script_packages(packages: DataFrame, files: DataFrame) -> DataFrame:
    """name, hooks, helpers, signals and blob of packages (name, scripts map, native) that run code on install; a native build
    without a hook of its own counts as one. files: name, path and text of what the packages hold."""
    hook = F.map_filter(F.coalesce("scripts", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*HOOKS))
    own = packages.select("name", "native", hook.alias("hooks"))
    default = F.col("native") & ~F.map_contains_key("hooks", "install") & ~F.map_contains_key("hooks", "preinstall")
    own = own.withColumn("hooks", F.when(default, F.map_concat("hooks", F.create_map(F.lit("install"), F.lit("node-gyp rebuild")))).otherwise(F.col("hooks"))).where(F.size("hooks") > 0)
    own = own.select("name", F.array_sort(F.map_keys("hooks")).alias("hooks"), F.array_join(F.array_sort(F.map_values("hooks")), "\n").alias("commands"))
    asked = own.select("name", F.explode(F.array_distinct(helper_files(F.col("commands")))).alias("word")).withColumn("path", F.regexp_replace("word", r"^(?:\./)+", ""))
    # A path can't reach out of its package, as files are listed by package.
    found = asked.join(files, ["name", "path"]).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("h"))
    rows = own.join(found, "name", "left").withColumn("body", F.concat_ws("\n", "commands", F.array_join(F.transform("h", lambda x: x["text"]), "\n")))
    out = F.when(F.contains("body", F.lit("../")) | F.contains("body", F.lit("..\\")), F.array(F.lit(OUTSIDE))).otherwise(F.array().cast("array<string>"))
    helpers = F.coalesce(F.transform("h", lambda x: x["path"]), F.array().cast("array<string>"))
    return rows.select("name", "hooks", helpers.alias("helpers"), F.concat(signals(F.col("body"), "javascript"), out).alias("signals"), N.longest_blob(F.col("body")).alias("blob"))


#: Bytes that are counted at once, and the parts of a bit in which sums are kept, so that adding and taking away leaves no error.
BLOCK, UNIT = 1 << 20, float(1 << 36)


def _block_bits(pieces: list[bytes], width: int) -> np.ndarray:
    """The largest entropy of the windows of each piece, none of them shorter than a window. A window differs from the one before by a byte in and a byte out, whose counts are differences of ranks."""
    x, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    n, starts, at = len(x), np.cumsum(size) - size, np.arange(len(x))
    stride = n + width + 1
    key = (np.repeat(np.arange(len(pieces)), size) * 256 + x) * stride + at
    order = np.argsort(key, kind="stable")
    ranked, rank = key[order], np.empty(n, np.int64)
    rank[order] = at
    # f(c) is what a byte that stands c times in a window adds to the sum of c log c.
    f = np.rint(np.arange(width + 1) * np.log2(np.maximum(np.arange(width + 1), 1)) * UNIT).astype(np.int64)
    step = np.append(0, np.diff(f))
    change = step[rank + 1 - np.searchsorted(ranked, key - width + 1)]
    leaves = np.flatnonzero(at - np.repeat(starts, size) >= width)
    gone = leaves - width
    change[leaves] -= step[np.searchsorted(ranked, key[gone] + width) - rank[gone]]
    total = np.cumsum(change)
    total -= np.repeat(total[starts] - change[starts], size)
    total[at - np.repeat(starts, size) < width - 1] = np.iinfo(np.int64).max
    return np.log2(width) - np.minimum.reduceat(total, starts) / UNIT / width


def _window_bits(texts: list[bytes], width: int) -> np.ndarray:
    """The largest entropy of any window of each text, in blocks of many texts, or of parts of a long one that overlap."""
    best, held, size = np.zeros(len(texts)), [], 0

    def flush() -> None:
        if held:
            np.maximum.at(best, [i for i, _ in held], _block_bits([p for _, p in held], width))

    for i, t in enumerate(texts):
        for a in range(0, len(t) - width + 1, BLOCK):
            held.append((i, t[a : a + BLOCK + width - 1]))
            size += len(held[-1][1])
            if size >= BLOCK:
                flush()
                held, size = [], 0
    flush()
    return best


def sliding_entropy(texts: DataFrame, text: str, width: int = 64) -> DataFrame:
    """texts with ``bits``: the largest Shannon entropy of any ``width`` consecutive bytes, 0 for shorter texts; in Arrow batches, as each byte opens a window."""
    ship(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["bits"] = _window_bits([(t or "").encode() for t in f[text]], width)
            yield f

    return spread(texts).mapInPandas(run, ", ".join([f"`{n}` {k}" for n, k in texts.dtypes] + ["bits double"]))


def explosion(new: DataFrame, requested: DataFrame, most: int = 50) -> DataFrame:
    """Projects that got more new packages beyond the requested ones than a command should bring."""
    extra = new.join(requested.select("project", "name"), ["project", "name"], "left_anti").groupBy("project").agg(F.countDistinct("name").alias("extra"))
    return _verdict(extra.where(F.col("extra") > most), "INSTALL/DependencyExplosion", "medium", False)


def new_executables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Executable files (path, executable) that are there after an install and weren't before."""
    return after.where("executable").select("path").exceptAll(before.where("executable").select("path"))


def execution_order(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """nodes with ``rank``: 0 without dependencies, else one more than the largest rank of what they need, so that dependencies run first.
    Level by level; members of a cycle, and what needs them, have none. More than ``most`` levels are an error, not a guess."""
    # Sorted, not broadcast: what is found over all levels would pass through the driver.
    merged = lambda df: df.hint("merge")
    left = settled(edges.select("src", "dst").distinct())
    fresh = settled(nodes.join(merged(left.select(F.col("src").alias("node")).distinct()), "node", "left_anti").select("node"))
    done, left = fresh.withColumn("rank", F.lit(0)), left.where("src <> dst")
    for level in range(1, most + 2):
        # What is settled has no edges left, so each level meets the last one's nodes only.
        open_ = settled(left.join(merged(fresh.select(F.col("node").alias("dst"))), "dst", "left_anti"))
        ready = left.select(F.col("src").alias("node")).distinct().join(merged(open_.select(F.col("src").alias("node"))), "node", "left_anti")
        fresh, left = settled(ready), open_
        if fresh.isEmpty():
            return nodes.join(merged(done), "node", "left")
        done = done.unionByName(fresh.withColumn("rank", F.lit(level)))
        done = settled(done) if level % 50 == 0 else done
    raise ValueError(f"more than {most} levels of dependencies")


def script_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """lockfile, node and rank: the order in which a lockfile's packages finish when each is visited after what it depends on, in a cycle too.

    nodes: lockfile, node, at (its place there); edges: lockfile, src, dst, at (their order). Packages are entered by place and dependencies in their order; one that is being visited
    isn't entered again. Which of a cycle's packages comes first depends on all visits before, so a lockfile, one document, is one group; edges to what it doesn't hold count for nothing."""

    def visit(key: tuple, held: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("at").drop_duplicates("node")
        known = set(held["node"])
        needs: dict = {}
        for src, dst in links.sort_values("at")[["src", "dst"]].itertuples(index=False):
            if dst in known:
                needs.setdefault(src, []).append(dst)
        entered, finished = set(), []
        for start in held["node"]:
            path = [(start, iter(needs.get(start, ())))] if start not in entered else []
            entered.add(start)
            while path:
                node, rest = path[-1]
                new = next((d for d in rest if d not in entered), None)
                if new is None:
                    finished.append(node)
                    path.pop()
                else:
                    entered.add(new)
                    path.append((new, iter(needs.get(new, ()))))
        return pd.DataFrame({"lockfile": pd.Series([key[0]] * len(finished), dtype=object), "node": pd.Series(finished, dtype=object), "rank": range(len(finished))})

    types = dict(nodes.dtypes)
    links = edges.select("lockfile", "src", "dst", "at")
    return nodes.select("lockfile", "node", "at").groupBy("lockfile").cogroup(links.groupBy("lockfile")).applyInPandas(visit, f"lockfile {types['lockfile']}, node {types['node']}, rank bigint")


def gate(findings: DataFrame, checks: DataFrame, no_fail: bool = False) -> DataFrame:
    """One row: whether an install halts at this phase, which a finding or a check that didn't finish makes it do."""
    n = findings.agg(F.count_if("blocks").alias("blocking"), F.count_if(~F.col("blocks")).alias("warnings"))
    m = checks.agg(F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "incomplete").alias("incomplete"))
    halts = F.lit(not no_fail) & ((F.col("blocking") > 0) | (F.col("errors") > 0) | (F.col("incomplete") > 0))
    return n.crossJoin(m).withColumn("halts", halts)


def hook_decision(installs: Column, findings: Column, unfinished: Column, warnings: Column, allow_on_pass: bool = False) -> Column:
    """What to answer to a command: nothing without installs, deny with findings, ask where something is open, else silence or leave."""
    clean = F.lit("allow") if allow_on_pass else F.lit(None).cast("string")
    return F.when(installs == 0, F.lit(None)).when(findings > 0, "deny").when((unfinished > 0) | (warnings > 0), "ask").otherwise(clean)


def screened(lines: DataFrame, column: str = "command") -> DataFrame:
    """One row an install command found in shell lines: folder, manager, names (version parts cut off), ``unchecked`` where it can't be planned, and why."""
    return shell.installs(lines, column).select(*lines.columns, "folder", "manager", "names", F.col("why").isNotNull().alias("unchecked"), "why")
