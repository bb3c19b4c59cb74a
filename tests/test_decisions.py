"""Decisions on installs, shell lines, wider scans and matching of known findings, on small hand-made tables."""

import math
from collections import Counter

import pytest

from sievework.operators import install as I
from sievework.operators import scan as S
from sievework.operators import suppress as U


def test_sliding_entropy_is_that_of_every_window(spark):
    texts = ["", "a" * 63, "a" * 64, "ab" * 60, "".join(chr(33 + i % 90) for i in range(200)), "é" * 40 + "x"]

    def brute(t):
        data = t.encode()
        bits = lambda w: -sum(c / 64 * math.log2(c / 64) for c in Counter(w).values())
        return max((bits(data[i : i + 64]) for i in range(len(data) - 63)), default=0.0)

    rows = I.sliding_entropy(spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string"), "t").collect()
    assert {r["id"]: round(r["bits"], 9) + 0.0 for r in rows} == {i: round(brute(t), 9) + 0.0 for i, t in enumerate([*texts, ""])}


def test_order_leaves_cycles_out(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    got = {r["node"]: r["rank"] for r in I.execution_order(edges, nodes).collect()}
    assert got == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}


def test_shell_lines(spark):
    lines = ["npm i left-pad@1", "echo npm install x", "A=1 env pip install 'a==1' -r b.txt | cat", "ls; yarn add @s/p@2 && cargo add `x`", None, ""]
    rows = I.screened(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, command string")).collect()
    got = sorted((r["id"], r["manager"], tuple(r["names"] or ()), r["unchecked"]) for r in rows)
    assert got == [(0, "npm", ("left-pad",), False), (2, "pip", ("a",), False), (3, "cargo", (), True), (3, "yarn", ("@s/p",), False)]


def test_bad_patterns_are_errors_before_anything_runs(spark):
    assert S.checked_patterns([("a", "x+")]) == [("a", "x+")]
    with pytest.raises(ValueError, match="bad"):
        S.checked_patterns([("a", "x"), ("bad", "(")])


def test_each_entry_is_claimed_once(spark):
    schema = "rule string, path string, match string, line long, occurrence long, fingerprint string"
    head = [("R", "p", "m", 10, 0, "f1"), ("R", "p", "m", 20, 1, "f2"), ("R", "p", "m", 30, 2, "f3"), ("Q", "new", "k", 5, 0, "g1"), ("Q", "p", "", 1, 0, "h1")]
    base = [("R", "p", "m", 12, 0, "f1"), ("R", "p", "m", 31, 1, "old"), ("Q", "was", "k", 7, 0, "g0"), ("Q", "q", "", 1, 0, "h0"), ("Z", "z", "z", 1, 0, "z")]
    found, free = U.known(spark.createDataFrame(head, schema), spark.createDataFrame(base, schema))
    assert {(r["fingerprint"], r["how"], r["moved_from"]) for r in found.collect()} == {("f1", "exact", None), ("f2", "shifted", None), ("f3", None, None), ("g1", "moved", "was"), ("h1", None, None)}
    assert {r["fingerprint"] for r in free.collect()} == {"h0", "z"}


def test_scan_of_files_with_and_without_states(spark):
    """Files without markers and blocks give what they give among others."""
    key = "AKIA" + "Q3Z7" * 4
    files = [("plain", f"x\nk = '{key}'\n"), ("marked", f"// sievework: ignore reason=old\nk = '{key}'\nk = '{key}'"), ("none", None), ("empty", "")]
    rows = S.scan(spark.createDataFrame(files, "path string, text string")).collect()
    got = sorted((r["path"], r["line"], r["suppressed"]) for r in rows if r["value"] == key)
    assert got == [("marked", 2, "old"), ("marked", 3, None), ("plain", 2, None)]


def test_scripts_of_cycles_have_an_order(spark):
    nodes = [("l", n, i) for i, n in enumerate(["app", "b", "a", "c", "lone"])] + [("m", "x", 0)]
    edges = [("l", "app", "a", 0), ("l", "app", "b", 1), ("l", "a", "c", 0), ("l", "c", "a", 0), ("l", "c", "b", 1), ("l", "b", "b", 0), ("l", "b", "gone", 1), ("m", "x", "a", 0), ("n", "p", "q", 0)]
    got = I.script_order(spark.createDataFrame(nodes, "lockfile string, node string, at int"), spark.createDataFrame(edges, "lockfile string, src string, dst string, at int")).collect()
    assert [r["node"] for r in sorted((r for r in got if r["lockfile"] == "l"), key=lambda r: r["rank"])] == ["b", "c", "a", "app", "lone"]
    assert [(r["lockfile"], r["node"], r["rank"]) for r in got if r["lockfile"] != "l"] == [("m", "x", 0)]


def test_a_file_of_another_package_doesnt_stand_for_a_phantom(spark):
    events = spark.createDataFrame([("a", "tmp/x", "create"), ("b", "tmp/x", "create"), ("c", "y", "create"), ("c", "", "overflow")], "package string, path string, kind string")
    after = spark.createDataFrame([("b", "tmp/x")], "package string, path string")
    gone, checks = I.vanished(events, after)
    assert [(r["package"], r["path"]) for r in gone.collect()] == [("a", "tmp/x")] and [r["package"] for r in checks.collect()] == ["c"]
    assert I.vanished(events, after.select("path"))[0].count() == 0
