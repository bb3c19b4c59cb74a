"""Install decisions over tables projected from the driver's: packages are parts, projects suppliers, scripts documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import install as I
from .scan_queries import table


#: Lines that stand at the end of the documents, by turns.
CODE = ("eval(x); fetch(u)", "requests.get(u); os.environ", "reqwest::get(u); sh -c x", "curl x", "import a")


def _parts(spark, sf_dir):
    """One package a part, its traits from its key."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("pkg-"), k.cast("string")).alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_brand").alias("brand"),
        (k % 3 == 0).alias("suspicious"), (k % 5 == 0).alias("scripts_off"), (k % 7 == 0).alias("allowlisted"), (k % 2 == 0).alias("isolated"), (k % 11 == 0).alias("one_step"),
    )


def install_build_policy(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    allowed = parts.where("version <> '7' and brand like '%1'").select("name")
    return I.not_allowed_builds(parts, allowed).select("name", "rule", "severity", "blocks")


def install_script_verdicts(spark, sf_dir):
    return I.script_verdicts(_parts(spark, sf_dir)).select("name", "rule", "severity", "blocks", "approved")


def _snapshots(spark, sf_dir):
    """A file an order, in its customer's package: some are there only before or only after, some differ."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("pkg-"), F.col("o_custkey").cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("size"), (F.col("o_orderkey") % 4 == 0).alias("executable"),
    )
    before = o.where("k % 5 <> 0")
    after = o.where("k % 7 <> 0").withColumn("size", F.when(F.col("k") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return before, after


def install_changes(spark, sf_dir):
    return I.changes(*_snapshots(spark, sf_dir), ["size", "executable"])


def install_foreign_writes(spark, sf_dir):
    """Each change is laid to the package of the path's number modulo 50; its own folder holds what it may write."""
    found = I.changes(*_snapshots(spark, sf_dir), ["size", "executable"])
    number = F.regexp_extract("path", "^pkg-([0-9]+)/", 1).cast("int")
    found = found.withColumn("package", F.regexp_extract("path", "f([0-9]+)$", 1).cast("bigint") % 50)
    rows = I.foreign_writes(found, number % 50 == F.col("package"))
    return rows.select("package", "what", "files", F.array_join("samples", ",").alias("samples"), "rule")


def install_new_executables(spark, sf_dir):
    return I.new_executables(*_snapshots(spark, sf_dir))


def install_vanished(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 997 == 0, "overflow").when(F.col("value") > 20, "create").otherwise("write")
    events = e.select(F.col("user_id").alias("package"), F.concat_ws("/", F.col("event_type"), (F.col("event_id") % 300).cast("string")).alias("path"), kind.alias("kind"))
    after = e.where("event_id % 2 = 0").select(F.concat_ws("/", F.col("event_type"), (F.col("event_id") % 300).cast("string")).alias("path"))
    gone, checks = I.vanished(events, after)
    return gone.select("package", "path", "rule").unionByName(checks.select("package", F.lit("").alias("path"), F.col("status").alias("rule")))


def install_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    published = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, F.sha2(F.lit(b"x"), 256)).otherwise(F.upper(F.sha2(content, 256)))
    return I.hash_rules(d.select("doc_id", content.alias("content"), published.alias("sha256"))).select("doc_id", "rule", "severity", "blocks")


def install_source_builds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    items = li.select(
        F.col("l_suppkey").alias("project"), F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").cast("string").alias("version"),
        F.when(F.col("l_returnflag") == "R", "sdist").otherwise("wheel").alias("kind"), (F.col("l_discount") > 0.005).alias("isolated"),
    )
    return I.source_builds(items).select("project", F.size("items").alias("items"), F.element_at("items", 1).alias("first"), "rule")


def install_source_permissions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat_ws("\n", "text", F.when(F.col("doc_id") % 4 == 0, "os.system('x')").when(F.col("doc_id") % 9 == 0, "import subprocess"))
    rows = I.source_permissions(d.select("doc_id", text.alias("text"), (F.col("doc_id") % 3 == 0).alias("isolated"), (F.col("doc_id") % 5 == 0).alias("allowlisted")))
    return rows.select("doc_id", F.array_join("signals", "|").alias("signals"), "blob", "rule", "severity", "may_build")


def install_build_scripts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat_ws("\n", "text", F.when(F.col("doc_id") % 4 == 0, 'Command::new("cc"); fs::write(a, b)').when(F.col("doc_id") % 9 == 0, "reqwest::get(u)"))
    rows = I.build_scripts(d.select("doc_id", text.alias("text"), (F.col("doc_id") % 5 == 0).alias("allowlisted")))
    return rows.select("doc_id", F.array_join("signals", "|").alias("signals"), "blob", "severity", "blocks")


def script_signals_all_kinds(spark, sf_dir):
    """How many documents hold each needle of each kind of script."""
    extra = F.element_at(F.array(*map(F.lit, CODE)), (F.col("doc_id") % len(CODE) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.concat_ws("\n", "text", extra).alias("text"))
    found = None
    for kind in I.SIGNALS:
        rows = d.select(F.lit(kind).alias("kind"), F.explode(I.signals(F.col("text"), kind)).alias("needle"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("kind", "needle").agg(F.count("*").alias("documents"))


def install_startup_code(spark, sf_dir):
    p = _parts(spark, sf_dir)
    line = F.when(F.col("id") % 4 == 0, "import os; os.system('x')").when(F.col("id") % 4 == 1, "import sys").when(F.col("id") % 4 == 2, "./lib").otherwise("import a; exec(b)")
    return I.startup_code(p.select("name", "allowlisted", line.alias("content"))).select("name", F.array_join("signals", "|").alias("signals"), "severity", "blocks")


def install_blocked_writes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 50 == 0, "OSError: [Errno 30] Read-only file system").otherwise(F.col("props"))
    return I.blocked_writes(e.select("event_id", line.alias("content"))).select("event_id", "rule", "severity")


def script_packages(spark, sf_dir):
    p = _parts(spark, sf_dir)
    command = F.when(F.col("id") % 4 == 0, "node ./install.js && sh build.sh").when(F.col("id") % 4 == 1, "node-gyp rebuild; curl x").when(F.col("id") % 4 == 2, "node ../other.js")
    scripts = F.when(command.isNotNull(), F.create_map(F.when(F.col("id") % 8 < 4, "postinstall").otherwise("test"), command))
    packages = p.select("name", scripts.alias("scripts"), (F.col("id") % 6 == 0).alias("native"))
    files = p.where("id % 3 = 0").select("name", F.lit("install.js").alias("path"), F.lit("fetch('u'); eval(x)").alias("text"))
    rows = I.script_packages(packages, files)
    return rows.select("name", F.array_join("hooks", ",").alias("hooks"), F.array_join("helpers", ",").alias("helpers"), F.array_join("signals", "|").alias("signals"))


def install_explosion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("name"), "l_linenumber")
    return I.explosion(li, li.where("l_linenumber = 1")).select("project", "extra", "rule")


def _steps(spark, sf_dir):
    """Parts need the part of half their number; numbers below ten need none."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = p.where("node >= 10").select(F.col("node").alias("src"), F.floor(F.col("node") / 2).cast("bigint").alias("dst"))
    return edges.join(p.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), p


def execution_order(spark, sf_dir):
    edges, nodes = _steps(spark, sf_dir)
    return I.execution_order(edges, nodes)


def install_script_order(spark, sf_dir):
    """A lockfile a nation, whose customers depend on each other like a heap, children after parents, and on their parents, which makes cycles."""
    by = Window.partitionBy("c_nationkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("lockfile"), (F.row_number().over(by.orderBy("c_custkey")) - 1).alias("at"))
    nodes = c.select("lockfile", F.concat(F.lit("n"), F.col("at").cast("string")).alias("node"), "at")
    to = F.array(F.floor((F.col("at") - 1) / 2), F.col("at") * 2 + 1, F.col("at"), F.col("at") * 2 + 2)
    edges = c.select("lockfile", F.concat(F.lit("n"), F.col("at").cast("string")).alias("src"), F.posexplode(to).alias("nth", "d")).select("lockfile", "src", F.concat(F.lit("n"), F.col("d").cast("string")).alias("dst"), F.col("nth").alias("at"))
    return I.script_order(nodes, edges)


def install_gate(spark, sf_dir):
    found = I.script_verdicts(_parts(spark, sf_dir)).where("rule is not null")
    labels = table(spark, sf_dir, "labels")
    checks = labels.select(F.when(F.col("toxic") == 1, "incomplete").otherwise("passed").alias("status"))
    return I.gate(found, checks)


def hook_decisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    n = lambda m: (F.col("id") % m == 0).cast("int")
    decide = lambda allow: I.hook_decision(F.col("id") % 4, n(5), n(3), n(7), allow)
    return p.select("id", decide(False).alias("silent"), decide(True).alias("opted_in"))


#: Shell lines by a part's key, $n its number; with folder, manager, names and whether the install is unchecked, for each install in it.
SHELL_LINES = (
    ("cd a && CI=1 npm install --save lib$n@1.2 @s/x@2", [("a", "npm", "lib$n @s/x", False)]),
    ("pip install lib$n==2.0; echo done", [("", "pip", "lib$n", False)]),
    ("sudo cargo add $(cat lib$n)", [("", "cargo", None, True)]),
    ("npm run lib$n", []),
    ("pip3 install -r req$n.txt Lib$n[x]", [("", "pip", "lib$n", False)]),
    ("python -m pip install 'lib$n >= 2'", [("", "pip", "lib$n", False)]),
    ("npm --prefix web$n clean-install", [("web$n", "npm", "", False)]),
    ("echo 'a; npm install lib$n' # yarn add y", []),
    ("sh -c \"cd w$n && sh -c 'yarn add l$n'\"; /usr/bin/npm i -g x", [("w$n", "yarn", "l$n", False), ("", "npm", None, True)]),
    ("sudo -u root -D /r$n npm i lib$n", [("/r$n", "npm", "lib$n", False)]),
    ("uv pip install ./local$n other$n", [("", "pip", "other$n", False)]),
    ("env -S 'npm install lib$n'", [("", None, None, True)]),
    ("npm --new-option v install lib$n", [("", "npm", None, True)]),
    ("(cd b$n; yarn) | tee log", [("b$n", "yarn", "", False)]),
    ("timeout 5 env A=1 bun --cwd s$n add -d lib$n@3", [("s$n", "bun", "lib$n", False)]),
    ("cargo add serde$n --features derive && cd t$n && cargo install z", [("", "cargo", "serde$n", False), ("t$n", "cargo", None, True)]),
)


def screened_commands(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.element_at(F.array(*(F.lit(x) for x, _ in SHELL_LINES)), (k % len(SHELL_LINES) + 1).cast("int"))
    lines = table(spark, sf_dir, "part").select(k.alias("id"), F.replace(line, F.lit("$n"), k.cast("string")).alias("command"))
    return I.screened(lines).select("id", "folder", "manager", F.array_join("names", " ").alias("names"), "unchecked")


def sliding_entropy(spark, sf_dir):
    return I.sliding_entropy(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name", "p_type", F.md5("p_name")).alias("t")), "t").select("p_partkey", F.round("bits", 6).alias("bits"))


def _needles(kind: str, text: str) -> str:
    return "list_filter([" + ", ".join("'" + s.replace("'", "''") + "'" for s in I.SIGNALS[kind]) + f"], lambda s: contains({text}, s))"


_PARTS = """parts AS (
  SELECT p_partkey AS id, 'pkg-' || p_partkey AS name, CAST(p_size AS VARCHAR) AS version, p_brand AS brand, p_partkey % 3 = 0 AS suspicious, p_partkey % 5 = 0 AS scripts_off,
         p_partkey % 7 = 0 AS allowlisted, p_partkey % 2 = 0 AS isolated, p_partkey % 11 = 0 AS one_step FROM part
)"""
_VERDICTS = f"""WITH {_PARTS},
v AS (SELECT *, suspicious AND NOT scripts_off AND NOT (allowlisted OR (isolated AND NOT one_step)) AS blocks FROM parts)"""
_CHANGES = """WITH o AS (
  SELECT 'pkg-' || o_custkey || '/f' || o_orderkey AS path, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 4 = 0 AS executable FROM orders
),
old AS (SELECT * FROM o WHERE k % 5 <> 0),
new AS (SELECT path, k, CASE WHEN k % 3 = 0 THEN size + 1 ELSE size END AS size, executable FROM o WHERE k % 7 <> 0),
changes AS (
  SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'created' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS what
  FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR old.size <> new.size OR old.executable <> new.executable
)"""
_BLOB = """list_max(list_transform(list_filter(regexp_extract_all(t, '[A-Za-z0-9+/=_-]{120,}'), lambda r: regexp_matches(r, '[0-9]') AND regexp_matches(r, '[A-Za-z]')
  AND NOT (r[1] = '/' AND len(list_filter(string_split(r, '/'), lambda s: s <> '')) >= 3 AND len(list_filter(string_split(r, '/'), lambda s: length(s) >= 64)) = 0)), lambda r: length(r)))"""

_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_SCREENED = ", ".join(f"({k}, {_quoted(d)}, {_quoted(m)}, {_quoted(n)}, {u})" for k, (_, found) in enumerate(SHELL_LINES) for d, m, n, u in found)
QUERIES = {f.__name__: f for f in (
    install_build_policy, install_script_verdicts, install_changes, install_foreign_writes, install_new_executables, install_vanished, install_hashes, install_source_builds, install_source_permissions,
    install_build_scripts, script_signals_all_kinds, install_startup_code, install_blocked_writes, script_packages, install_explosion, execution_order, install_script_order, install_gate, hook_decisions, screened_commands, sliding_entropy,
)}
ORACLES = {
    "install_build_policy": f"WITH {_PARTS} SELECT name, 'INSTALL/BuildNotAllowed' AS rule, 'low' AS severity, false AS blocks FROM parts WHERE NOT (version <> '7' AND brand LIKE '%1')",
    "install_script_verdicts": f"""{_VERDICTS} SELECT name, CASE WHEN suspicious THEN 'INSTALL/SuspiciousScript' END AS rule, CASE WHEN blocks THEN 'high' WHEN suspicious THEN 'medium' END AS severity, blocks, NOT blocks AS approved FROM v""",
    "install_changes": f"{_CHANGES} SELECT * FROM changes",
    "install_foreign_writes": f"""{_CHANGES},
p AS (SELECT *, CAST(regexp_extract(path, 'f([0-9]+)$', 1) AS BIGINT) % 50 AS package, CAST(regexp_extract(path, '^pkg-([0-9]+)/', 1) AS INT) % 50 AS own FROM changes),
n AS (SELECT *, row_number() OVER (PARTITION BY package, what ORDER BY path) AS nth FROM p WHERE package <> own)
SELECT package, what, count(*) AS files, string_agg(path, ',' ORDER BY path) FILTER (WHERE nth <= 5) AS samples, 'INSTALL/ForeignWrite' AS rule FROM n GROUP BY package, what""",
    "install_new_executables": f"{_CHANGES} SELECT path FROM new WHERE executable EXCEPT ALL SELECT path FROM old WHERE executable",
    "install_vanished": """WITH e AS (SELECT user_id AS package, event_type || '/' || event_id % 300 AS path, event_id, CASE WHEN event_id % 997 = 0 THEN 'overflow' WHEN value > 20 THEN 'create' ELSE 'write' END AS kind FROM events),
lost AS (SELECT DISTINCT package FROM e WHERE kind = 'overflow')
SELECT DISTINCT package, path, 'INSTALL/PhantomFile' AS rule FROM e WHERE kind = 'create' AND path NOT IN (SELECT path FROM e WHERE event_id % 2 = 0) AND package NOT IN (SELECT package FROM lost)
UNION ALL SELECT package, '', 'incomplete' FROM lost""",
    "install_hashes": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'INSTALL/NoHash' ELSE 'INSTALL/HashMismatch' END AS rule, CASE doc_id % 4 WHEN 0 THEN 'medium' ELSE 'high' END AS severity, doc_id % 4 = 1 AS blocks
FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 4 = 1 AND sha256(coalesce(text, '')) <> sha256('x'))""",
    "install_source_builds": """SELECT l_suppkey AS project, CAST(count(DISTINCT l_partkey || '==' || l_linenumber) AS INT) AS items, min(l_partkey || '==' || l_linenumber) AS first, 'INSTALL/SourceBuild' AS rule
FROM lineitem WHERE l_returnflag = 'R' AND l_discount <= 0.005 GROUP BY l_suppkey""",
    "install_source_permissions": f"""WITH d AS (SELECT doc_id, concat_ws(chr(10), text, CASE WHEN doc_id % 4 = 0 THEN 'os.system(''x'')' WHEN doc_id % 9 = 0 THEN 'import subprocess' END) AS t FROM documents),
s AS (SELECT doc_id, {_needles('python', 't')} AS signals, CAST({_BLOB} AS INT) AS blob FROM d),
j AS (SELECT *, len(signals) > 0 OR blob IS NOT NULL AS bad FROM s),
k AS (SELECT *, bad AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS stop FROM j)
SELECT doc_id, array_to_string(signals, '|') AS signals, blob, CASE WHEN bad THEN 'INSTALL/SuspiciousScript' END AS rule, CASE WHEN stop THEN 'high' WHEN bad THEN 'medium' END AS severity, NOT stop AS may_build FROM k""",
    "install_build_scripts": f"""WITH d AS (SELECT doc_id, concat_ws(chr(10), text, CASE WHEN doc_id % 4 = 0 THEN 'Command::new("cc"); fs::write(a, b)' WHEN doc_id % 9 = 0 THEN 'reqwest::get(u)' END) AS t FROM documents),
s AS (SELECT doc_id, {_needles('build-strong', 't')} AS signals, CAST({_BLOB} AS INT) AS blob FROM d)
SELECT doc_id, array_to_string(signals, '|') AS signals, blob, CASE WHEN doc_id % 5 = 0 THEN 'medium' ELSE 'high' END AS severity, doc_id % 5 <> 0 AS blocks FROM s WHERE len(signals) > 0 OR blob IS NOT NULL""",
    "script_signals_all_kinds": f"WITH d AS (SELECT concat_ws(chr(10), text, {list(CODE)}[doc_id % {len(CODE)} + 1]) AS t FROM documents) "
    + " UNION ALL ".join(f"SELECT '{kind}' AS kind, needle, count(*) AS documents FROM d, unnest({_needles(kind, 't')}) AS n(needle) GROUP BY needle" for kind in I.SIGNALS),
    "install_startup_code": f"""WITH {_PARTS},
l AS (SELECT *, CASE id % 4 WHEN 0 THEN 'import os; os.system(''x'')' WHEN 1 THEN 'import sys' WHEN 2 THEN './lib' ELSE 'import a; exec(b)' END AS t FROM parts),
s AS (SELECT *, {_needles('python', 't')} AS signals FROM l WHERE starts_with(t, 'import '))
SELECT name, array_to_string(signals, '|') AS signals, CASE WHEN allowlisted THEN 'medium' ELSE 'high' END AS severity, NOT allowlisted AS blocks FROM s WHERE len(signals) > 0""",
    "install_blocked_writes": "SELECT event_id, 'INSTALL/BlockedWrite' AS rule, 'high' AS severity FROM events WHERE event_id % 50 = 0 OR regexp_matches(props, 'Read-only file system|Errno 30|EROFS')",
    "script_packages": f"""WITH {_PARTS},
c AS (
  SELECT id, name, id % 6 = 0 AS native, CASE WHEN id % 8 < 4 THEN CASE id % 4 WHEN 0 THEN 'node ./install.js && sh build.sh' WHEN 1 THEN 'node-gyp rebuild; curl x' WHEN 2 THEN 'node ../other.js' END END AS command FROM parts
),
h AS (
  SELECT id, name, concat_ws(',', CASE WHEN native THEN 'install' END, CASE WHEN command IS NOT NULL THEN 'postinstall' END) AS hooks, CASE WHEN command IS NOT NULL AND id % 4 = 0 AND id % 3 = 0 THEN 'install.js' ELSE '' END AS helpers, command, native
  FROM c WHERE native OR command IS NOT NULL
),
t AS (SELECT *, concat_ws(chr(10), CASE WHEN native THEN 'node-gyp rebuild' END, command, CASE WHEN helpers <> '' THEN 'fetch(''u''); eval(x)' END) AS t FROM h)
SELECT name, hooks, helpers, array_to_string(list_concat({_needles('javascript', 't')}, CASE WHEN contains(t, '../') THEN ['{I.OUTSIDE}'] ELSE [] END), '|') AS signals FROM t""",
    "install_explosion": """WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT l.l_suppkey AS project, count(DISTINCT l.l_partkey) AS extra FROM lineitem l ANTI JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_partkey = r.l_partkey GROUP BY l.l_suppkey)
SELECT project, extra, 'INSTALL/DependencyExplosion' AS rule FROM n WHERE extra > 50""",
    "execution_order": """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 10 AND p_partkey // 2 IN (SELECT p_partkey FROM part)),
r (node, rank) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT src FROM e) UNION ALL SELECT e.src, r.rank + 1 FROM r JOIN e ON e.dst = r.node)
SELECT node, max(rank) AS rank FROM r GROUP BY node""",
    "install_script_order": """WITH c AS (SELECT c_nationkey AS lockfile, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT lockfile, 'n' || i AS node, row_number() OVER (PARTITION BY lockfile ORDER BY substr(bin(i + 1), 2) || '~') - 1 AS rank FROM c""",
    "install_gate": f"""{_VERDICTS},
n AS (SELECT count(*) FILTER (blocks) AS blocking, count(*) FILTER (NOT blocks) AS warnings FROM v WHERE suspicious),
m AS (SELECT CAST(0 AS BIGINT) AS errors, count(*) FILTER (toxic = 1) AS incomplete FROM labels)
SELECT *, blocking > 0 OR errors > 0 OR incomplete > 0 AS halts FROM n, m""",
    "hook_decisions": """WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'deny' WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'ask' END AS x FROM part)
SELECT id, nullif(x, '') AS silent, CASE WHEN x = '' THEN NULL ELSE coalesce(x, 'allow') END AS opted_in FROM d""",
    "screened_commands": f"""WITH r(k, folder, manager, names, unchecked) AS (VALUES {_SCREENED})
SELECT p_partkey AS id, replace(folder, '$n', CAST(p_partkey AS VARCHAR)) AS folder, manager, replace(names, '$n', CAST(p_partkey AS VARCHAR)) AS names, unchecked FROM part JOIN r ON k = p_partkey % {len(SHELL_LINES)}""",
    "sliding_entropy": """WITH t AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_name, p_type, md5(p_name)) AS t FROM part)
SELECT p_partkey, round(coalesce(list_max(list_transform(range(1, length(t) - 62), lambda i: list_aggregate(string_split(substr(t, i, 64), ''), 'entropy'))), 0.0), 6) AS bits FROM t""",
}
