"""The stateful streams, started anew for each batch on one checkpoint, give what the batch forms give."""

import random
from datetime import datetime, timedelta

from sievework.streaming import watch

START = datetime(2024, 5, 1)


def streamed(spark, folder, batches, schema, make):
    """All rows of a stream over batches that arrive one by one, with a restart before each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_phantoms_after_restarts(spark, tmp_path):
    rng = random.Random(6)
    schema, events, at = "path string, ts timestamp, kind string", [], 0
    for _ in range(260):
        at += rng.randrange(1, 40)
        events.append((f"f{rng.randrange(60)}", START + timedelta(seconds=at), rng.choice(["create", "modify", "delete", "delete"])))
    cuts = [events[i : i + 65] for i in range(0, len(events), 65)]
    for c in cuts:
        rng.shuffle(c)
    # An event far behind the last lets all paths be judged.
    cuts.append([("end", START + timedelta(days=1), "modify")])
    got = streamed(spark, tmp_path, cuts, schema, lambda df: watch.phantom_stream(df, "3 hours"))
    want = watch.phantoms(spark.createDataFrame(events, schema))
    rows = lambda df: {(r["path"], r["created"], r["deleted"]) for r in df.collect()}
    assert rows(got) == rows(want) and rows(want)


def test_changes_after_restarts(spark, tmp_path):
    rng = random.Random(7)
    schema = "path string, poll long, mtime timestamp"
    polls = [(f"f{p}", k, START + timedelta(minutes=rng.randrange(1 + k))) for k in range(6) for p in range(12)]
    got = streamed(spark, tmp_path, [polls[:36], polls[36:48], polls[48:]], schema, watch.changed_stream)
    key = lambda df: {tuple(r) for r in df.select("path", "poll", "mtime").collect()}
    assert key(got) == key(watch.changed(spark.createDataFrame(polls, schema)))
