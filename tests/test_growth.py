"""Steps whose cost once grew faster than their input."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from sievework.functions import versions
from sievework.operators import install as I
from sievework.operators import review as V
from sievework.operators import suppress as U
from sievework.sources import coverage as C
from sievework.operators import install as I
from sievework.operators import static as A
from sievework.sources import ignores as G
from sievework.sources import patches as P


def test_name_status_of_a_large_record(spark):
    """A fold that appended to an array took time with the square of the record."""
    n = 60000
    raw = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 2 == 0, F.concat(F.lit("M\0p"), i.cast("string"))).otherwise(F.concat(F.lit("R100\0o"), i.cast("string"), F.lit("\0p"), i.cast("string")))), "\0")
    got = P.name_status(spark.range(1).select(raw.alias("raw")))
    assert got.groupBy("status").agg(F.count("old").alias("old"), F.count_distinct("path").alias("paths")).orderBy("status").collect() == [("M", 0, n // 2), ("R", n // 2, n // 2)]


def test_name_status_of_odd_records(spark):
    rows = [(x,) for x in ("\0\0M\0\0a\nb\0", "C75\0o\0p\0R1\0left", "A", "R\0a\0b\0D\0c\0M", "", None)]
    got = {tuple(r) for r in P.name_status(spark.createDataFrame(rows, "raw string")).collect()}
    assert got == {("M", None, "a\nb"), ("C", "o", "p"), ("R", "a", "b"), ("D", None, "c")}


def test_texts_are_read_where_they_lie(spark):
    """Windows over the lines of patches and reports shuffled and sorted every line."""
    files = spark.createDataFrame([(1, "diff --git a/x b/x\n+++ b/x\n@@ -1 +7 @@\n+a\n-b\n"), (2, None)], "k int, text string")
    report = spark.createDataFrame([(1, "DA:9,9\nSF:a\nDA:2,1\nDA:1,0\nDA:x,1\nDA:2,3\nend_of_record\nSF:a\nDA:1,4\nLH: 1\nLH:y\nLF:2\nend_of_record\n"), (2, None)], "k int, text string")
    for df in (P.diff_lines(files, "k"), C.lcov_totals(report, "k"), C.lcov_lines(report, "k")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in P.diff_lines(files, "k").collect()] == [(1, None, "x", "+", 7, "a"), (1, None, "x", "-", 8, "b")]
    assert [tuple(r) for r in C.lcov_totals(report, "k").collect()] == [(1, "a", 0, 0), (1, "a", 0, 2)]
    assert sorted(tuple(r) for r in C.lcov_lines(report, "k").collect()) == [(1, "a", 1, 4), (1, "a", 2, 3)]


def test_claims_in_a_large_group():
    """A search of all free entries for each finding took time with the square of the group; results are the plain search's."""
    rng = random.Random(5)
    frame = lambda lines: pd.DataFrame({"rule": "r", "path": "p", "match": "m", "line": lines, "occurrence": [rng.randrange(4) for _ in lines]})
    for _ in range(150):
        left, right = (frame([rng.randrange(12) for _ in range(rng.randrange(1, 9))]) for _ in range(2))
        free, want = sorted(zip(right["line"], right["occurrence"], strict=True)), []
        for line, occ in sorted(zip(left["line"], left["occurrence"], strict=True)):
            best = min(range(len(free)), key=lambda i: (abs(free[i][0] - line), abs(free[i][1] - occ), i), default=None)
            want.append(free.pop(best)[0] if best is not None else None)
        assert [None if pd.isna(x) else x for x in U._nearest(left, right)["base_line"]] == want
    began = time.process_time()
    assert U._nearest(frame(list(range(0, 80000, 2))), frame(list(range(1, 80000, 2))))["base_line"].notna().all()
    assert time.process_time() - began < 20


def test_coverage_files_of_one_name(spark):
    """Paths met by their last part alone, all against all; they meet by whole endings now, with the same files."""
    rng = random.Random(3)
    paths = {"/".join(rng.choice(["a", "ba", "c", ""]) for _ in range(rng.randrange(0, 4))) + rng.choice(["/x.py", "x.py", "/"]) for _ in range(60)}
    files = {"/".join(rng.choice(["a", "ba", "c"]) for _ in range(rng.randrange(0, 4))) + rng.choice(["/x.py", "x.py", "/"]) for _ in range(60)}
    df = V.coverage_file(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(f,) for f in files], "path string"))
    want = {}
    for p in paths:
        met = [f for f in files if f.split("/")[-1] == p.split("/")[-1] and (f.endswith(p) or p.endswith(f))]
        if met:
            want[p] = min(met, key=lambda f: (f != p, -len(f), f))
    assert {r["path"]: r["file"] for r in df.collect()} == want
    assert "tail" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_versions_are_matched_once(spark):
    """A key matched its pattern for each of its parts, and again wherever it was mentioned."""
    key = versions.order_key(F.col("v"), F.lit("PyPI"))
    plan = spark.createDataFrame([("1.0",)], "v string").select(key.alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("alpha|") <= 2


def test_levels_stay_off_the_driver(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (6, 4), (7, 7), (8, 99)], "src int, dst int")
    got = I.execution_order(edges, spark.createDataFrame([(i,) for i in range(1, 9)], "node int"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert dict(got.collect()) == {1: 2, 2: 1, 3: 0, 4: None, 5: None, 6: None, 7: None, 8: None}


def _tasks(found):
    return found.select(F.spark_partition_id()).distinct().count()


def test_entropy_of_a_small_file_of_many_rows_is_spread(spark):
    texts = spark.range(0, 400, 1, 1).select("id", F.repeat(F.md5(F.col("id").cast("string")), 4).alias("t"))
    assert _tasks(I.sliding_entropy(texts, "t")) > 1


def test_entropy_of_long_texts_and_many_in_a_block():
    """Parts of a long text overlap by a window less a byte, so the only window of 64 different bytes, across two parts, is found."""
    n = I.BLOCK - 30
    got = I._window_bits([b"a" * n + bytes(range(64)) + b"a" * 999, b"", b"a" * 64, b"ab" * 40, bytes(range(63))], 64)
    assert got.round(9).tolist() == [6.0, 0.0, 0.0, 1.0, 0.0]


def test_static_rules_of_a_small_file_of_many_rows_are_spread(spark):
    files = spark.range(0, 400, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.lit("eval(x)\ny = 'a'\n").alias("text"))
    assert _tasks(A.scan(files)) > 1 and _tasks(A.literal_lines(files)) > 1


def test_screening_of_a_small_file_of_many_rows_is_spread(spark):
    lines = spark.range(0, 400, 1, 1).select("id", F.concat(F.lit("npm i a"), "id").alias("command"))
    found = I.screened(lines)
    assert _tasks(found) > 1 and found.count() == 400


def test_paths_of_one_folder_are_dealt_over_parts(spark):
    """All paths lie below the root, whose ignore file met them in one task."""
    rows = spark.range(1000).select(F.concat(F.lit("src/f"), "id").alias("path"), F.explode(F.array(F.lit(""), F.lit("src"))).alias("dir"))
    side = spark.createDataFrame([("", "a"), ("", "b"), ("src", "c"), ("doc", "d")], "dir string, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = G._meet(rows, side.hint("merge"), each=20).withColumn("task", F.spark_partition_id()).collect()
        kept = G._meet(rows, side.where("dir = 'src'").select("dir"), "left_semi", 20).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r["path"], r["dir"], r["name"]) for r in got) == sorted((f"src/f{i}", d, n) for i in range(1000) for d, n in (("", "a"), ("", "b"), ("src", "c")))
    assert len({r["task"] for r in got if r["name"] == "a"}) > 1
    assert sorted((r["path"], r["dir"]) for r in kept) == sorted((f"src/f{i}", "src") for i in range(1000))


def test_tree_of_more_paths_than_meet_in_a_task(spark):
    n = 2 * G.EACH
    files = spark.range(n).select(F.concat(F.when(F.col("id") % 2 == 0, "x/").otherwise("out/"), "id", F.when(F.col("id") % 3 == 0, ".log").otherwise(".c")).alias("path"), F.lit("").alias("text"))
    left = G.walked(files.unionByName(spark.createDataFrame([(".gitignore", "*.log\nout/\n")], "path string, text string"))).where("path <> '.gitignore'")
    assert left.count() == sum(i % 2 == 0 and i % 3 > 0 for i in range(n)) and left.where("path like 'out/%' or path like '%.log'").isEmpty()
