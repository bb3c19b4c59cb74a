"""Recall on vectors with and without structure, the share that the sample tells, and rows that repeat an id."""

import numpy as np
import pytest

from sievework.llm import ann


def exact(x, ids, every, k):
    u = ann.unit(x)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = u @ u[i]
        score[i] = -np.inf
        out[int(ids[i])] = {int(j) for j in ids[np.lexsort((ids, -score))[:k]]}
    return out


def found(df, **more):
    out = {}
    for r in ann.nearest(df, **more).collect():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    if kind == "clusters":
        x = rng.normal(size=(60, 32))[np.arange(6000) % 60] * 4 + x * 0.3
    ids = np.arange(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = found(df, least=0), exact(x, ids, 50, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.9


def test_share_follows_structure():
    rng = np.random.default_rng(6)
    noise = ann.unit(rng.normal(size=(3000, 32)))
    near = ann.unit(rng.normal(size=(60, 32))[np.arange(3000) % 60] * 4 + rng.normal(size=(3000, 32)) * 0.3)
    shares = [ann.share_for(ann.Forest(x), x, 5) for x in (noise, near)]
    assert shares[1] < 0.1 < 0.4 < shares[0]
    one = noise[:1]
    assert ann.share_for(ann.Forest(one), one, 5) == 1.0


def test_rows_of_one_id_take_one_place(spark):
    rng = np.random.default_rng(7)
    at = np.ones(8)
    rows = [(0, at.tolist())]
    rows += [(0, (at + 1e-4 * rng.normal(size=8)).tolist()) for _ in range(20)]  # the query's own id again
    rows += [(3, (at + 1e-3 * rng.normal(size=8)).tolist()) for _ in range(20)]  # another one, often
    rows += [(10 + i, (at + 0.1 * rng.normal(size=8)).tolist()) for i in range(8)]
    got = [r for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("rank <= 5").collect() if r["query_id"] == 0]
    assert all(r["vec_id"] != 0 for r in got) and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    assert all(r["vec_id"] == 3 for r in got if r["rank"] == 1) and sum(r["vec_id"] == 3 for r in got) * 5 == len(got)
