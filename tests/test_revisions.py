"""Merge bases of random histories against sets, and files along two renames and a merge."""

import random

from sievework.sources import revisions as R

COMMITS, STATUS, AT = "repo int, commit string, parent string, nth int", "repo int, commit string, status string, old string, path string", "repo int, commit string"


def test_merge_bases_of_random_histories(spark):
    rng = random.Random(2)
    rows, heads, targets, want = [], [], [], set()
    for repo in range(25):
        parents = {0: []}
        for i in range(1, 30):
            parents[i] = rng.sample(range(i), min(i, rng.choice([1, 1, 1, 2, 3])))
        up = {}
        for i in range(30):
            up[i] = {i}.union(*(up[p] for p in parents[i]))
            rows += [(repo, f"c{i}", f"c{p}", n) for n, p in enumerate(parents[i])] or [(repo, "c0", None, 0)]
        a, b = rng.sample(range(15, 30), 2)
        common = up[a] & up[b]
        want |= {(repo, f"c{x}") for x in common if not any(x in up[y] - {y} for y in common)}
        heads.append((repo, f"c{a}"))
        targets.append((repo, f"c{b}"))
    got = R.merge_bases(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(heads, AT), spark.createDataFrame(targets, AT))
    assert {tuple(r) for r in got.select("repo", "commit").collect()} == want


def test_since_follows_renames(spark):
    commits = [(1, "a", None, 0), (1, "b", "a", 0), (1, "t", "b", 0), (1, "c", "b", 0), (1, "d", "c", 0), (1, "d", "t", 1), (1, "e", "d", 0)]
    status = [
        (1, "a", "A", "x", "x"), (1, "a", "A", "keep", "keep"), (1, "a", "A", "gone", "gone"), (1, "b", "M", "x", "x"), (1, "t", "A", "of_t", "of_t"), (1, "c", "R090", "x", "y"), (1, "c", "D", "gone", "gone"),
        (1, "d", "A", "of_t", "of_t"), (1, "e", "R100", "y", "z"), (1, "e", "A", "new", "new"), (1, "e", "C075", "keep", "copy"),
    ]
    tables = spark.createDataFrame(commits, COMMITS), spark.createDataFrame(status, STATUS)
    head, target = spark.createDataFrame([(1, "e")], AT), spark.createDataFrame([(1, "b")], AT)
    got = {(r["path"], r["kind"], r["base"], r["base_path"], r["base_in"]) for r in R.since(*tables, head, target).collect()}
    assert got == {("z", "R", "b", "x", "b"), ("new", "A", "b", None, None), ("copy", "A", "b", None, None), ("of_t", "A", "b", None, None)}
    files = {(r["path"], r["changed_in"]) for r in R.files_at(tables[1], target, R.jumps(tables[0])).collect()}
    assert files == {("x", "b"), ("keep", "a"), ("gone", "a")}
    assert R.since(*(t.limit(0) for t in tables), head.limit(0), target.limit(0)).count() == 0
