"""Suppression, dependency trees, linters, coverage, static rules and parsers on small fixtures."""

from pyspark.sql import functions as F

from sievework.operators import deps as D
from sievework.operators import lint as N
from sievework.operators import review as V
from sievework.operators import static as A
from sievework.operators import suppress as U
from sievework.sources import coverage as C
from sievework.sources import files as W
from sievework.sources import lockfiles as K
from sievework.sources import manifests as Y
from sievework.sources import patches as P
from sievework.streaming import watch as M


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_shifted_claims_the_nearest_once(spark):
    schema = "rule string, path string, match string, line long, occurrence long"
    head = spark.createDataFrame([("r", "p", "m", 10, 0), ("r", "p", "m", 12, 1), ("r", "p", "m", 99, 2)], schema)
    base = spark.createDataFrame([("r", "p", "m", 11, 0), ("r", "p", "m", 13, 1)], schema)
    assert [(r["line"], r["base_line"]) for r in U.shifted(head, base).orderBy("line").collect()] == [(10, 11), (12, 13), (99, None)]


def test_expired_exception_does_not_suppress(spark):
    f = spark.createDataFrame([("src/a.py", "R")], "path string, rule string")
    rule = [{"id": "E", "rule": "R", "path": "src/*.py", "expires": "2024-01-31"}]
    got = lambda day: U.exceptions(f, rule, F.lit(day).cast("date")).first()
    assert got("2024-01-31")["suppressed"] and not got("2024-02-01")["suppressed"] and got("2024-02-01")["expired"]


def test_globs():
    import re

    match = lambda g, p: re.match(U.glob_regex(g), p) is not None
    assert match("**/a.py", "a.py") and match("**/a.py", "x/y/a.py") and not match("*.py", "x/a.py") and match("src/**", "src/x/y") and not match("a?c", "a/c")


def test_why_takes_a_shortest_chain_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("r", "c"), ("c", "b"), ("b", "d"), ("d", "a")], "src string, dst string")
    roots = spark.createDataFrame([("r",)], "node string")
    assert {r["node"]: r["chain"] for r in D.why(spark, edges, roots).collect()} == {"r": ["r"], "a": ["r", "a"], "c": ["r", "c"], "b": ["r", "a", "b"], "d": ["r", "a", "b", "d"]}


def test_unknown_signals_raise_none(spark):
    df = spark.createDataFrame([(None, True, None, None, None, None, [], None)], "published timestamp, install_script boolean, previous_install_script boolean, provenance boolean, previous_provenance boolean, publisher string, earlier array<string>, withdrawn string")
    assert D.release_signals(df, F.current_timestamp()).count() == 0


def test_container_file(spark):
    text = ["FROM node", "RUN apt-get update", "RUN apt-get install -y --no-install-recommends curl", "FROM scratch", "FROM a AS b", "ADD https://x/y /z"]
    df = spark.createDataFrame([("D", i + 1, t) for i, t in enumerate(text)], "path string, line int, content string")
    assert rows(N.container_rules(df), "line", "rule") == [(0, "no-healthcheck"), (0, "no-user-directive"), (1, "no-latest-image"), (3, "apt-stale-cache")]


def test_blob(spark):
    path, blob = "/" + "/".join(["segment1"] * 20), "a1" * 70
    df = spark.createDataFrame([(path,), (blob,), ("a" * 200,)], "t string").select("t", N.longest_blob(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {path: None, blob: 140, "a" * 200: None}


def test_diff(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,3 @@\n keep\n-gone\n+++ plus\n+two\n\\ No newline at end of file\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-all\n"
    got = P.diff_lines(spark.createDataFrame([(1, text)], "patch int, text string"))
    assert rows(got, "path", "kind", "line", "content") == [("x", "+", 4, "++ plus"), ("x", "+", 5, "two"), ("x", "-", 4, "gone")]


def test_lcov_last_entry_counts(spark):
    text = "SF:a\nDA:1,0\nDA:1,5\nLH:1\nLF:1\nend_of_record\nSF:b\nLH:x\nLF:2\nend_of_record\nSF:c\nLF:3"
    df = spark.createDataFrame([("r", text)], "report string, text string")
    assert rows(C.lcov_totals(df), "path", "hit", "found") == [("a", 1, 1), ("b", 0, 2)]
    assert rows(C.lcov_lines(df), "path", "line", "hits") == [("a", 1, 5)]


def test_cobertura_counts_method_lines_again(spark):
    x = '<coverage><class filename="a"><methods><method><lines><line number="1" hits="1"/></lines></method></methods><lines><line number="1" hits="1"/><line number="2" hits="0"/></lines></class></coverage>'
    assert rows(C.cobertura_totals(spark.createDataFrame([("r", x)], "report string, text string")), "path", "hit", "found") == [("a", 2, 3)]


def test_lockfiles():
    names = lambda path, text: [(r["name"], r["version"], r["source_kind"]) for r in K.parse(path, text)]
    assert names("a/yarn.lock", '# yarn lockfile v1\n\n"@s/a@^1.0.0":\n  version "1.2.0"\n  resolved "https://registry.invalid/@s/a/-/a-1.2.0.tgz#x"\n\nb@git+https://h/b.git:\n  version "2.0.0"\n  resolved "git+https://h/b.git#abc"\n') == [("@s/a", "1.2.0", "registry"), ("b", "2.0.0", "git")]
    assert names("pnpm-lock.yaml", "lockfileVersion: '9.0'\npackages:\n\n  '@s/a@1.2.0':\n    resolution: {integrity: sha512-x}\n\n  b@2.0.0:\n    resolution: {integrity: sha512-y}\n\nsnapshots:\n\n  b@2.0.0: {}\n") == [("@s/a", "1.2.0", "registry"), ("b", "2.0.0", "registry")]
    assert names("Cargo.lock", '[[package]]\nname = "own"\nversion = "0.1.0"\n\n[[package]]\nname = "g"\nversion = "1.0.0"\nsource = "git+https://h/g?rev=1#abc"\n') == [("own", "0.1.0", "path"), ("g", "1.0.0", "git")]
    assert names("poetry.lock", '[[package]]\nname = "a"\nversion = "1"\nfiles = [{file = "a.whl", hash = "sha256:x"}]\n') == [("a", "1", "registry")]
    assert names("requirements.txt", "a==1 ; python_version > '3' \\\n  --hash=sha256:x\n# via b\nc @ git+https://h/c@main\n") == [("a", "1", "registry"), ("c", "", "git")]
    assert names("go.mod", "module own\n\nrequire (\n\tx.y/a v1.0.0\n\tx.y/b v2.0.0 // indirect\n)\n\nreplace x.y/b => ../b\n") == [("own", "", "path"), ("x.y/a", "v1.0.0", "registry"), ("x.y/b", "v2.0.0", "path")]
    assert names("bun.lock", '{"packages": {"a": ["a@1.0.0", "", {"dependencies": {"b": "1"}}, "sha512-x"],}}') == [("a", "1.0.0", "registry")]
    assert K.parse("package-lock.json", "{")[0]["error"]


def test_yaml_subset():
    text = "on:\n  pull_request_target:\njobs:\n  a:\n    steps:\n    - uses: x/checkout@v1\n      with: {ref: head}\n    - run: |\n        one\n        two\n  b: [1, 'x', true]\n# end\n"
    assert Y.load(text) == {"on": {"pull_request_target": None}, "jobs": {"a": {"steps": [{"uses": "x/checkout@v1", "with": {"ref": "head"}}, {"run": "one\ntwo"}]}, "b": [1, "x", True]}}


def test_exceptions_file_lists_every_error():
    rules, errors = Y.exceptions('[[exception]]\nid = "a"\nreason = "r"\nowner = "o"\nexpires = 2024-01-01\n[exception.match]\nrule = "R"\n[[exception]]\nid = "a"\nexpires = "soon"\ncolour = 1\n')
    assert len(rules) == 2 and len(errors) == 6


def test_static_rules(spark):
    cases = [
        ("a.ts", "// eval(x)\nconst s = 'eval(y)';\neval(z)", ["SAST/EvalUsage"]),
        ("b.js", "el.innerHTML = 'safe'; el.innerHTML = DOMPurify.sanitize(x)", []),
        ("c.js", "const q = location.search;\nconst r = q + 1;\nel.innerHTML = r", ["SAST/InnerHTMLAssignment [tainted]"]),
        ("d.js", "/x/.exec(s); regex.exec(s); cp.exec(s)", ["SAST/ChildProcessExec"]),
        ("e.py", "subprocess.run('x', shell=True)\nyaml.load(x, Loader=L)", ["SAST/PythonSubprocessShell", "SAST/PythonYamlLoad"]),
        ("f.py", "def (", []),
        ("g.txt", "eval(x)", []),
        ("h.js", "function f(a, b, c, d, e, g) {\n" + "x;\n" * 60 + "}", ["SMELL/LongFunction", "SMELL/TooManyParameters"]),
    ]
    found = {}
    for r in A.scan(spark.createDataFrame([c[:2] for c in cases], "path string, text string")).orderBy("path", "line", "rule").collect():
        found.setdefault(r["path"], []).append(r["rule"] if "[tainted]" in r["rule"] else r["rule"].split(" ")[0])
    for path, text, want in cases:
        assert found.get(path, []) == want, text


def test_binary_and_latin1_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.bin").write_bytes(b"\xff\x00\x01")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.txt").write_bytes(b"x")
    got = W.texts(W.tree(spark, str(tmp_path), ["skip/**"]))
    assert rows(got, "path", "text") == [("a.txt", "caf\ufffd")]


def test_coverage_path_prefers_exact_then_longest(spark):
    paths = spark.createDataFrame([("src/a.py",), ("b.py",)], "path string")
    files = spark.createDataFrame([("a.py",), ("root/src/a.py",), ("x/b.py",), ("b.py",)], "path string")
    assert rows(V.coverage_file(paths, files), "path", "file") == [("b.py", "b.py"), ("src/a.py", "root/src/a.py")]


def test_streams_agree_with_batches(spark, tmp_path):
    import pandas as pd

    t = pd.Timestamp("2024-01-01")
    events = pd.DataFrame({"path": ["a", "b", "a", "c"], "ts": [t, t, t + pd.Timedelta("1m"), t + pd.Timedelta("1h")], "kind": ["create", "create", "delete", "create"], "poll": [1, 1, 2, 3], "mtime": [t, t, t, t]})
    for i, part in enumerate((events.iloc[:3], events.iloc[3:])):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = M.changed_stream(stream.select("path", "poll", "mtime")).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = M.changed(spark.read.parquet(str(tmp_path / "in")).select("path", "poll", "mtime"))
    assert rows(spark.table("changed"), "path") == rows(batch, "path")
    q = M.windows_stream(stream.withColumnRenamed("kind", "event_type")).writeStream.format("memory").outputMode("complete").queryName("hours").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").count() == 3
