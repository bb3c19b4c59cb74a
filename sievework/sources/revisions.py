"""A repository's history as tables: what two revisions have in common, and the files as they were there.

commits: repo, commit, parent, nth (0 for the first parent; a root has no row or a null parent), status: repo, commit, status, old, path, what a commit changes
against its first parent. First-parent chains are walked by jumps of doubling length, so a history of a million commits takes twenty joins; other parents are followed
from all commits found so far at once, so the rounds are the nesting of merges. The files at a commit are an as-of fold: of all changes to a path along the chain, the last one up to there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import settled

KEY = ["repo", "commit"]


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def jumps(commits: DataFrame) -> list[DataFrame]:
    """repo, commit, to: the first-parent ancestors 1, 2, 4, 8 and so on before each commit that has one."""
    step = settled(commits.where((F.col("nth") == 0) & F.col("parent").isNotNull()).select(*KEY, F.col("parent").alias("to")))
    out = []
    while not step.isEmpty():
        out.append(step)
        far = step.select("repo", F.col("commit").alias("to"), F.col("to").alias("far"))
        step = settled(step.join(far, ["repo", "to"]).select(*KEY, F.col("far").alias("to")))
    return out


def chains(starts: DataFrame, jumps_: list[DataFrame]) -> DataFrame:
    """starts (repo, commit, and what else they carry) and their first-parent ancestors, with ``back``: how far before the start they lie."""
    found = starts.withColumn("back", F.lit(0).cast("bigint"))
    for k, step in enumerate(jumps_):
        found = settled(_union(found, found.join(step, KEY).withColumn("commit", F.col("to")).withColumn("back", F.col("back") + (1 << k)).drop("to")))
    return found


def ancestors(commits: DataFrame, starts: DataFrame, jumps_: list[DataFrame]) -> DataFrame:
    """repo and commit of starts and all that lies before them."""
    found = fresh = settled(chains(starts.select(*KEY).distinct(), jumps_).select(*KEY).distinct())
    others = commits.where((F.col("nth") > 0) & F.col("parent").isNotNull())
    while True:
        side = fresh.join(others, KEY).select("repo", F.col("parent").alias("commit")).distinct().join(found, KEY, "left_anti")
        side = settled(side)
        if side.isEmpty():
            return found
        fresh = settled(chains(side, jumps_).select(*KEY).distinct().join(found, KEY, "left_anti"))
        found = settled(_union(found, fresh))


def merge_bases(commits: DataFrame, heads: DataFrame, targets: DataFrame, jumps_: list[DataFrame] | None = None) -> DataFrame:
    """repo and commit of the best common ancestors of each repo's head and target: those before no other common one. A criss-cross history has several.

    Common ancestors have all theirs among them, so the best are those that are no common one's parent."""
    jumps_ = jumps(commits) if jumps_ is None else jumps_
    common = ancestors(commits, heads, jumps_).join(ancestors(commits, targets, jumps_), KEY, "left_semi")
    parents = common.join(commits, KEY).select("repo", F.col("parent").alias("commit")).where("commit is not null")
    return common.join(parents, KEY, "left_anti")


def events(status: DataFrame) -> DataFrame:
    """repo, commit, path, present, old: a rename takes its old path away and puts its new one in place."""
    kind = F.substring("status", 1, 1)
    kept = status.select(*KEY, "path", (kind != "D").alias("present"), F.when(kind.isin("R", "C"), F.col("old")).alias("old"), (kind == "R").alias("moved"))
    gone = status.where(kind == "R").select(*KEY, F.col("old").alias("path"), F.lit(False).alias("present"), F.lit(None).cast("string").alias("old"), F.lit(False).alias("moved"))
    return kept.unionByName(gone)


def files_at(status: DataFrame, at: DataFrame, jumps_: list[DataFrame]) -> DataFrame:
    """repo, path and changed_in (the commit whose content a file has) of the files at each repo's commit."""
    line = chains(at.select(*KEY), jumps_)
    last = line.join(events(status), KEY).groupBy("repo", "path").agg(F.min_by(F.struct("present", F.col("commit").alias("changed_in")), F.struct("back", ~F.col("present"))).alias("e"))
    # Of two changes in one commit, as of a path that one file leaves and another takes, the one that puts a file there counts.
    return last.where("e.present").select("repo", "path", "e.changed_in")


def since(commits: DataFrame, status: DataFrame, heads: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, path, kind (A, M or R), base, base_path and base_in of the files at the heads that differ from the merge base with the target.

    base_path is the file's path there, along its renames; base_in the commit whose content it has there; both are null for a new file. Of several
    bases the last by name counts. Renames are followed along the head's first parents, back to where the base's history begins."""
    steps = jumps(commits)
    base = settled(merge_bases(commits, heads, targets, steps).groupBy("repo").agg(F.max("commit").alias("commit")))
    before = ancestors(commits, base, steps)
    line = chains(heads.select(*KEY), steps).join(before, KEY, "left_anti")
    then = files_at(status, base, steps)
    now = settled(files_at(status, heads, steps))
    moves = settled(line.join(events(status).where("moved"), KEY).select("repo", "path", "old", F.col("back").alias("moved_back")))
    open_ = settled(now.select("repo", "path", F.col("path").alias("was"), F.lit(-1).cast("bigint").alias("at")))
    done = None
    while True:
        # Each file's latest rename before the one it was followed to.
        step = open_.join(moves.withColumnRenamed("path", "was"), ["repo", "was"], "left").withColumn("fits", F.col("moved_back") > F.col("at"))
        step = settled(step.groupBy("repo", "path", "was", "at").agg(F.min(F.when(F.col("fits"), F.struct("moved_back", "old"))).alias("next")))
        ended = step.where("next is null").select("repo", "path", "was")
        done = ended if done is None else done.unionByName(ended)
        open_ = settled(step.where("next is not null").select("repo", "path", F.col("next.old").alias("was"), F.col("next.moved_back").alias("at")))
        if open_.isEmpty():
            break
    both = now.join(done, ["repo", "path"]).join(then.select("repo", F.col("path").alias("was"), F.col("changed_in").alias("base_in")), ["repo", "was"], "left")
    kind = F.when(F.col("base_in").isNull(), "A").when(F.col("was") != F.col("path"), "R").otherwise("M")
    rows = both.where(~F.col("base_in").eqNullSafe(F.col("changed_in"))).join(base.withColumnRenamed("commit", "base"), "repo")
    return rows.select("repo", "path", kind.alias("kind"), "base", F.when(F.col("base_in").isNotNull(), F.col("was")).alias("base_path"), "base_in")
