"""Python's version order and keys against the packaging library."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import versions as V


def test_order_is_packagings(spark):
    packaging = pytest.importorskip("packaging.version")
    rng = random.Random(8)
    part = lambda *x: rng.choice(x)
    texts = {
        f"{part('', '', '1!', 'v')}{rng.randrange(3)}{part('', '.0', '.0.0', '.1', '.10', '.2')}{part('', '', 'a1', '-alpha.2', 'b', '_rc3', '.pre')}{part('', '', '.post1', '-2', 'r3')}{part('', '', '.dev0', 'dev4')}{part('', '', '', '+abc', '+1.a', '+a-2')}"
        for _ in range(400)
    } | {"", "latest", "1..2", "1.0-", "x1", " 1.0 "}

    def key(t):
        try:
            return packaging.Version(t)
        except packaging.InvalidVersion:
            return None

    good = {t: key(t) for t in texts}
    ranks = {k: i for i, k in enumerate(sorted({v for v in good.values() if v is not None}))}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.pep440_key(F.col("t")).alias("k"))
    rows = rows.select("t", "k", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy(F.col("k").asc_nulls_last())).alias("r")).collect()
    assert {r["t"]: (r["r"] - 1 if r["k"] is not None else None) for r in rows} == {t: (ranks[v] if v is not None else None) for t, v in good.items()}
