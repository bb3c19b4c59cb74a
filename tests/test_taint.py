"""Taint by function: probes, and generated programs against a plain fixpoint."""

import random

import pytest

from sievework.operators import static, taint

HTML, MARKED = "SAST/InnerHTMLAssignment", "SAST/InnerHTMLAssignment [tainted]"
PROBES = [
    ("const x = req.query.a; function f(){ const x = 'lit'; el.innerHTML = x }", []),
    ("const x = 'lit'; function f(){ const x = req.query.a; el.innerHTML = x }", [MARKED]),
    ("const x = req.query.a; function f(){ el.innerHTML = x }", [HTML]),
    ("a.innerHTML = `<b>${req.query.q}</b>`", [MARKED]),
    ("a.innerHTML = `<b>${'x'} ${1}</b>`", []),
    ("a.innerHTML = `<b>${y}</b>`", [HTML]),
    ("a.innerHTML = `plain`", []),
    ("el.innerHTML = DOMPurify.sanitize(x) + y;", [HTML]),
    ("const y = req.body.z; el.innerHTML = DOMPurify.sanitize(x) + y;", [MARKED]),
    ("const y = DOMPurify.sanitize(req.body.z); el.innerHTML = '<i>' + y;", []),
    ("el.innerHTML = c ? 'a' : 'b'", [HTML]),
    ("el.innerHTML = (('a'))", []),
    ("el.innerHTML = await clean(x)", []),
    ("el.innerHTML = -1", [HTML]),
    ("const q = await req.body; const r = q.name; el.innerHTML = [r]", [MARKED]),
    ("const q = req.body; el.innerHTML = q[0]", [HTML]),
    ("const q = req.body; el.innerHTML = {a: q}", [HTML]),
    ("const q = localStorage.getItem('k'), r = f(g(q))\nel.innerHTML = r", [MARKED]),
    ("const f = x => { const a = e.data; el.outerHTML = a }", ["SAST/OuterHTMLAssignment [tainted]"]),
    ("list.map(x => el.innerHTML = 'a' + 'b')", []),
    ("class A { m(a) { const p = 'k'; eval(p); eval(a) } }", ["SAST/EvalUsage"]),
    ("// el.innerHTML = x\n'el.innerHTML = x'; s = /el.innerHTML = x/", []),
    ("document.write('a', x); document.writeln(location.hash)", ["SAST/DocumentWriteln [tainted]"]),
    ("setTimeout('f()', 1); setTimeout(`g`, 1); setInterval(f, 1)", ["SAST/SetTimeoutString"] * 2),
    ("new Function('return 1')", ["SAST/FunctionConstructor"]),
    ("cp.exec(cmd); /x/.exec(s); db.exec(q); f(x).exec(); const c = process.env; cp.spawn(c.X, []); cp.execSync('ls')", ["SAST/ChildProcessExec", "SAST/ChildProcessSpawn [tainted]", "SAST/ChildProcessExecSync"]),
    ("x = <div dangerouslySetInnerHTML={{__html: DOMPurify.sanitize(a)}} />; y = <p dangerouslySetInnerHTML={{ __html: a }} />", ["SAST/DangerouslySetInnerHTML"]),
    ("const q: string = req.query; el.innerHTML = q", [MARKED]),
    ("const a = b\nconst b = c\nconst c = req.params\nel.innerHTML = a", [MARKED]),
    ("const a = b + b; const b = c; const c = 'x'; el.innerHTML = a", []),
    ("el.innerHTML = getUserInput()", [MARKED]),
    ("`a${`b${c}`}", []),
    ("", []),
]


def test_probes(spark):
    files = spark.createDataFrame([(f"p{i:02}.tsx", "\n" * i + code) for i, (code, _) in enumerate(PROBES)] + [("null.js", None)], "path string, text string")
    got: dict[str, list] = {}
    for r in taint.scan(files).collect():
        got.setdefault(r["path"], []).append(r["rule"])
        assert r["line"] > int(r["path"][1:3])
    for i, (code, want) in enumerate(PROBES):
        # Findings of one rule and line are one.
        assert sorted(got.get(f"p{i:02}.tsx", [])) == sorted(set(want)), code
    assert "null.js" not in got


def program(rng):
    """Statements (name, operands): an operand is s (source), l (literal), c (call that cleans), u (unknown call's argument) or a name."""
    out = []
    for _ in range(rng.randrange(1, 12)):
        out.append((f"n{rng.randrange(5)}", [rng.choice(["s", "l", "c", "u", *(f"n{i}" for i in range(6))]) for _ in range(rng.randrange(1, 4))]))
    return out


def fixpoint(statements):
    safe, grown = set(), True
    while grown:
        more = {n for n, v in statements if all(x in "lc" or x in safe for x in v)} - safe
        safe |= more
        grown = bool(more)
    tainted = {n for n, v in statements if v == ["s"]}
    tainted |= {n for n, v in statements if ("s" in v or "c" in v) and n not in safe}  # a cleaned source beside other operands counts
    grown = True
    while grown:
        more = {n for n, v in statements if n not in safe and any(x in tainted or (x == "u" and "n0" in tainted) for x in v)} - tainted
        tainted |= more
        grown = bool(more)
    return safe, tainted


def test_generated_programs(spark):
    rng = random.Random(11)
    write = {"s": "req.body", "l": "'x'", "c": "he.encode(req.body)", "u": "run(n0)"}
    programs = [program(rng) for _ in range(150)]
    files = []
    for i, p in enumerate(programs):
        lines = [f"{n} = " + rng.choice([" + ", "\n + ", " || "]).join(write.get(x, x) for x in v) + rng.choice([";", ""]) for n, v in p]
        files.append((f"{i}.js", "function f() {\n" + "\n".join(lines) + "\n" + "\n".join(f"el.innerHTML = n{k}" for k in range(6)) + "\n}"))
    seen = taint._seen(taint.tokens(spark.createDataFrame(files, "path string, text string")))
    got = {(r["path"], r["name"]): (r["safe"], r["tainted"]) for r in taint.facts(taint.assignments(seen).join(taint.values(seen), ["path", "value"])).collect()}
    for i, p in enumerate(programs):
        safe, tainted = fixpoint(p)
        for k in range(6):
            assert got.get((f"{i}.js", f"n{k}"), (False, False)) == (f"n{k}" in safe, f"n{k}" in tainted), files[i][1]


def test_scan_takes_both_kinds_of_rules(spark):
    files = spark.createDataFrame([("a.py", "eval(x)"), ("b.js", "eval(x)\nfunction g(a,b,c,d,e,f) {}"), ("c.txt", "eval(x)")], "path string, text string")
    assert sorted((r["path"], r["line"], r["rule"]) for r in static.scan(files).collect()) == [("a.py", 1, "SAST/PythonEval"), ("b.js", 1, "SAST/EvalUsage"), ("b.js", 2, "SMELL/TooManyParameters (6, max 5: g)")]


@pytest.mark.parametrize("text", ["`", "${", "}", "))) }} ]", "'", "/", "=>", "`${", "`${`${", "a => ", "x = {", "/*"])
def test_broken_files_end(text):
    assert list(taint.lex(text)) is not None


def test_long_chains_take_no_rounds(spark):
    """A chain of names is followed within its function's group: the number of jobs doesn't grow with its length."""
    chain = "\n".join(f"n{i} = n{i + 1}" for i in range(300)) + "\nn300 = req.body.x\nel.innerHTML = n0"
    spark.sparkContext.setJobGroup("chains", "")
    got = taint.scan(spark.createDataFrame([("a.js", chain)], "path string, text string")).collect()
    spark.sparkContext.setJobGroup("tests", "")
    assert [(r["line"], r["rule"]) for r in got] == [(302, MARKED)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chains")) < 20


def test_pieces_read_as_the_whole_text():
    """A text is read a piece at a time, by steps kept from other texts; its rows are those of one piece."""
    rng = random.Random(5)
    parts = [
        "a", "b.c", "x = ", " = ", "req.body", "'s'", "`t`", "`a${", "}", "}`", "{", "(", ")", "[", "]", ";", ";\n", "{\n", "}\n", "\n", "\n  ", ".d", "\n .e", "?", ":", " => ", "function f(", ") {\n", ") => {\n", "/*", "*/",
        "// c;\n", "/re/", "el.innerHTML = ", "el.innerHTML = v;\n", "dangerouslySetInnerHTML={{__html: ", "}}", "__html: ", "eval(", "cp.exec(", "const k: string = ", "await ", " + ", "!", "\\", "${", ",", "clean(", "const g = (a) => {\n",
        "if (x) {\n", "});\n", "v = w;\n", "v = 'a' + w;\n", "v = req.query.x;\n", "'un;\n", "const o = {\n", "};\n", "/* x;\n y */",
    ]
    kept = taint.Reader()
    rows = lambda found: sorted(((*r[:4], r[4].kinds, r[4].around, r[4].name, r[4].known, r[4].rule) for r in found), key=repr)
    for i in range(4000):
        kept.missed = taint.PATIENCE + 1 if i % 50 == 0 else 0
        text, whole = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))), taint.Reader()
        step = whole._step(whole.start, text, True)
        assert rows(kept.read(text)) == rows((a, v, line + 1, f, x) for a, v, line, f, x in step.rows), text


def test_recurring_lines_are_read_once():
    """Each token of each file was looked at again, which took over a millisecond a file, and each value was a row that was shuffled."""
    reader = taint.Reader()
    texts = [f"function f() {{\n  v{i % 4} = req.query;\n  el.innerHTML = v{i % 3};\n}}\nconst g = (a) => {{\n  v1 = a\n  el.innerHTML = v{i % 4};\n}}\n" for i in range(500)]
    for text in texts:
        reader.judge(text)
    assert reader.steps < 60
    made = reader.made
    for i in range(2 * taint.STEPS):
        reader.judge(f"a{i} = b{i};\n")
    assert reader.steps <= taint.STEPS + 1 and len(reader.items) <= taint.STEPS + 1
    assert reader.made - made < taint.STEPS  # lines that never recur are seldom tried


def test_values_are_not_shuffled(spark):
    df = taint.scan(spark.createDataFrame([("a.js", "el.innerHTML = x")], "path string, text string"))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_functions_leave_whole(spark):
    """Names come out by function without groups of shuffled values, also those of a value that goes on behind its line and of a function within it."""
    text = "const g = (a) => {\n  v0 = req.query;\n  v1 = v0 + 'x';\n  v2 = 'y';\n}\nv3 = 'a' +\n  v4;\nconst v4 = 'b';\n"
    df = taint.names(spark.createDataFrame([("a.js", text), ("b.js", None)], "path string, text string"))
    got = {(r["scope"] >= 0, r["name"], r["safe"], r["tainted"]) for r in df.collect()}
    assert got == {(True, "v0", False, True), (True, "v1", False, True), (True, "v2", True, False), (False, "v3", True, False), (False, "v4", True, False)}
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
