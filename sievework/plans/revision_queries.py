"""Base revisions: a repository a customer, a commit an order, with a branch that was merged and one that the head left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import revisions as R
from .scan_queries import table


def _history(spark, sf_dir):
    """commits, status, heads and targets. Commit i follows i - 1; the commit at three quarters also has s for a parent, which left at a quarter; the target t left at a half."""
    by = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.row_number().over(by.orderBy("o_orderkey")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    name = lambda c: F.concat(F.lit("c"), F.lpad(c.cast("string"), 6, "0"))
    part = lambda k: F.floor((F.col("n") - 1) * k / 4)
    own = o.select("repo", name(F.col("i")).alias("commit"), F.when(F.col("i") > 0, name(F.col("i") - 1)).alias("parent"), F.lit(0).alias("nth"))
    merge = o.where((F.col("i") == part(3)) & (part(3) > part(1))).select("repo", name(F.col("i")).alias("commit"), F.lit("s").alias("parent"), F.lit(1).alias("nth"))
    side = o.where("i = 0").select("repo", F.lit("s").alias("commit"), name(part(1)).alias("parent"), F.lit(0).alias("nth"))
    target = o.where("i = 0").select("repo", F.lit("t").alias("commit"), name(part(2)).alias("parent"), F.lit(0).alias("nth"))
    commits = own.unionByName(merge).unionByName(side).unionByName(target)
    path = F.concat(F.lit("p"), (F.col("i") % 4).cast("string"))
    kind = F.when(F.col("i") % 10 == 9, "D").when(F.col("i") % 6 == 5, "R090").otherwise("M")
    new = F.when(kind == "R090", F.concat(F.lit("q"), F.col("i").cast("string"))).otherwise(path)
    # Every seventh commit moves a moved file on.
    again = o.where("i % 7 = 6 and i >= 6").select("repo", name(F.col("i")).alias("commit"), F.lit("R100").alias("status"), F.concat(F.lit("q"), (F.col("i") - F.col("i") % 6 - 1).cast("string")).alias("old"), F.concat(F.lit("r"), F.col("i").cast("string")).alias("path"))
    status = o.select("repo", name(F.col("i")).alias("commit"), kind.alias("status"), path.alias("old"), new.alias("path")).unionByName(again)
    heads = o.where("i = n - 1").select("repo", name(F.col("i")).alias("commit"))
    return commits, status, heads, target.select("repo", "commit")


def revision_bases(spark, sf_dir):
    commits, _, heads, targets = _history(spark, sf_dir)
    return R.merge_bases(commits, heads, targets)


def revision_files(spark, sf_dir):
    """Files at the target."""
    commits, status, _, targets = _history(spark, sf_dir)
    return R.files_at(status, targets, R.jumps(commits))


def revision_changes(spark, sf_dir):
    """Files at the head that differ from the base, with their place there."""
    return R.since(*_history(spark, sf_dir))


_NAME = "'c' || lpad(CAST({} AS VARCHAR), 6, '0')"
_BASE = """WITH RECURSIVE o AS (SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
ev AS (
  SELECT repo, i, 'p' || i % 4 AS path, NOT (i % 10 = 9 OR i % 6 = 5) AS present, NULL AS old FROM o
  UNION ALL SELECT repo, i, 'q' || i, true, 'p' || i % 4 FROM o WHERE i % 6 = 5 AND i % 10 <> 9
  UNION ALL SELECT repo, i, 'q' || (i - i % 6 - 1), false, NULL FROM o WHERE i % 7 = 6
  UNION ALL SELECT repo, i, 'r' || i, true, 'q' || (i - i % 6 - 1) FROM o WHERE i % 7 = 6
),
r AS (SELECT repo, max(n) - 1 AS head, CAST(floor((max(n) - 1) * 2 / 4) AS BIGINT) AS base FROM o GROUP BY repo),
fold AS (SELECT repo, mark, path, arg_max(present, (i, present)) AS present, max(i) AS i FROM ev JOIN (SELECT repo, base AS mark FROM r UNION SELECT repo, head FROM r) USING (repo) WHERE i <= mark GROUP BY ALL),
tree AS (SELECT repo, mark, path, i FROM fold WHERE present),
walk AS (
  SELECT repo, t.path, t.path AS was, head + 1 AS before, i AS changed FROM tree t JOIN r USING (repo) WHERE mark = head
  UNION ALL
  SELECT w.repo, w.path, e.old, e.i, w.changed FROM walk w JOIN r USING (repo) JOIN ev e ON e.repo = w.repo AND e.path = w.was AND e.old IS NOT NULL AND e.i < w.before AND e.i > r.base
),
origin AS (SELECT repo, path, arg_min(was, before) AS was, any_value(changed) AS changed FROM walk GROUP BY repo, path)
"""
QUERIES = {f.__name__: f for f in (revision_bases, revision_files, revision_changes)}
ORACLES = {
    "revision_bases": f"WITH o AS (SELECT o_custkey AS repo, count(*) AS n FROM orders GROUP BY 1) SELECT repo, {_NAME.format('CAST(floor((n - 1) * 2 / 4) AS BIGINT)')} AS commit FROM o",
    "revision_files": _BASE + f"SELECT repo, path, {_NAME.format('i')} AS changed_in FROM tree JOIN r USING (repo) WHERE mark = base",
    "revision_changes": _BASE + f"""SELECT g.repo, g.path, CASE WHEN b.i IS NULL THEN 'A' WHEN g.was <> g.path THEN 'R' ELSE 'M' END AS kind, {_NAME.format('r.base')} AS base, CASE WHEN b.i IS NOT NULL THEN g.was END AS base_path,
  CASE WHEN b.i IS NOT NULL THEN {_NAME.format('b.i')} END AS base_in
FROM origin g JOIN r USING (repo) LEFT JOIN tree b ON b.repo = g.repo AND b.mark = r.base AND b.path = g.was WHERE b.i IS DISTINCT FROM g.changed""",
}
