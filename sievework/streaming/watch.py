"""File monitoring, as batch queries and as stateful streams over the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed(polls: DataFrame) -> DataFrame:
    """Polls (path, poll, mtime) that see a file for the first time or newer than ever before."""
    before = Window.partitionBy("path").orderBy("poll").rowsBetween(Window.unboundedPreceding, -1)
    return polls.withColumn("seen", F.max("mtime").over(before)).where("seen is null or mtime > seen").drop("seen")


def phantoms(events: DataFrame) -> DataFrame:
    """path, created and deleted of files first seen by a creation and last by a deletion; events are path, ts and kind."""
    made, gone = F.col("kind") == "create", F.col("kind") == "delete"
    rows = events.groupBy("path").agg(
        F.min(F.when(made, F.col("ts"))).alias("created"), F.max(F.when(gone, F.col("ts"))).alias("deleted"), F.min_by("kind", "ts").alias("first"), F.max_by("kind", "ts").alias("last")
    )
    return rows.where("first = 'create' and last = 'delete' and created < deleted").select("path", "created", "deleted")


def changed_stream(polls: DataFrame) -> DataFrame:
    """The stream of ``changed``: the state of a path is the newest time seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("poll")
        out = []
        for r in rows.itertuples(index=False):
            if newest is None or r.mtime.value > newest:
                newest = r.mtime.value
                out.append((key[0], r.poll, r.mtime))
        state.update((newest,))
        yield pd.DataFrame(out, columns=["path", "poll", "mtime"])

    return polls.groupBy("path").applyInPandasWithState(step, "path string, poll long, mtime timestamp", "newest long", "append", "NoTimeout")


def phantom_stream(events: DataFrame, end: str = "10 minutes") -> DataFrame:
    """The stream of ``phantoms``: a path is judged, and forgotten, when the watermark passes its last event by ``end``.

    A path's state is its first and last event and the first creation and last deletion, by their times, so batches may come in any order that the watermark still takes;
    it is as large as one row. An event that comes after its path was judged begins it anew."""
    wait = pd.Timedelta(end).value // 10**6

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, first, _, last, created, deleted = state.get
            state.remove()
            if first == "create" and last == "delete" and created < deleted:
                yield pd.DataFrame({"path": [key[0]], "created": [pd.Timestamp(created)], "deleted": [pd.Timestamp(deleted)]})
            return
        began, first, ended, last, created, deleted = state.get if state.exists else (None,) * 6
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        times = rows["ts"].astype("int64")
        least = lambda a, b: b if a is None else min(a, b)
        most = lambda a, b: b if a is None else max(a, b)
        if began is None or times.iloc[0] < began:
            began, first = int(times.iloc[0]), rows["kind"].iloc[0]
        if ended is None or times.iloc[-1] > ended:
            ended, last = int(times.iloc[-1]), rows["kind"].iloc[-1]
        if len(made := times[rows["kind"] == "create"]):
            created = least(created, int(made.min()))
        if len(gone := times[rows["kind"] == "delete"]):
            deleted = most(deleted, int(gone.max()))
        state.update((began, first, ended, last, created, deleted))
        state.setTimeoutTimestamp(max(ended // 10**6 + wait, state.getCurrentWatermarkMs()))

    schema, kept = "path string, created timestamp, deleted timestamp", "began long, first string, ended long, last string, created long, deleted long"
    return events.withWatermark("ts", "0 seconds").groupBy("path").applyInPandasWithState(step, schema, kept, "append", "EventTimeTimeout")


def windows_stream(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling counts by type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
