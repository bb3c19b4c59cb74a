"""Enrichment of sales against a plain simulation and the SQL twin: ties, late rows, nulls, empty batches, wide clients."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from sievework.llm import enrichment

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, kind string, uid string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, batch string"
START = datetime(2024, 1, 1)


def shop(seed, n, m, clients, holes=()):
    rng = random.Random(seed)
    hour = lambda: START + timedelta(hours=rng.randrange(0, 120 * 24, 6))
    sales, changes = [], []
    for i in range(n):
        sold = None if rng.random() < 0.05 else hour()
        arrived = None if rng.random() < 0.01 else (sold or hour()) + timedelta(hours=rng.choice([0, 0, 1, 30, 400]))
        sales.append((i, rng.choice([None, 0, 0, *range(clients)]), "open", 1.0, sold, arrived, 1, "clash", "u"))
    for i in range(m):
        changes.append((rng.choice([i, i, i // 2]), rng.choice([None, 0, 0, *range(clients)]), 0, rng.choice(["I", "U", "D", None]), None if rng.random() < 0.05 else hour(), "web", None, "x", rng.choice([None, 1.005, -3.335, 20.0]), "clash"))
    out = lambda at: at is not None and any(a <= (at - START).days < b for a, b in holes)
    sales = [s for s in sales if not out(s[5])]
    return sales + sales[:5], [c for c in changes if not out(c[4])] + changes[:5]


def simulated(sales, changes):
    """The rules row by row, batch by batch."""
    number = lambda day: max(0, min(11, (day - 19723) * 12 // 152))
    day = lambda at: (at - datetime(1970, 1, 1)).days
    bought = [[] for _ in range(12)]
    for s in sales:
        bought[11 if s[5] is None else number(day(s[5]))].append(s)
    changed = [[] for _ in range(12)]
    for c in {c[:9] for c in changes}:
        if c[4] is not None:
            changed[number(day(c[4]) + zlib.crc32(str(c[0]).encode()) % 4)].append(c)
    order = lambda c: (c[4], c[0], c[3] is not None, c[3] or "", c[8] is not None, c[8] or 0)
    held, waiting, marks, out = [], [], [None, None], Counter()
    for k in range(13):
        h = min(marks) if None not in marks else None
        for c in changed[k] if k < 12 else ():
            if marks[1] is not None and c[4] < marks[1]:
                out[("late", c[0], k, None, None, None, None)] += 1
            else:
                held.append(c)
        waiting += bought[k] if k < 12 else []
        still = []
        for s in waiting:
            if k < 12 and s[4] is not None and (h is None or s[4] >= h):
                still.append(s)
                continue
            own = [c for c in held if s[1] is not None and c[1] == s[1]]
            fit = max((c for c in own if s[4] is not None and c[4] <= s[4]), key=order, default=None)
            cents = None if fit is None or fit[8] is None else int(np.floor(100 * fit[8] + 0.5))
            out[("sale", s[0], k, len(own), fit and fit[0], cents, fit and fit[3])] += 1
        waiting = still
        if h is not None:
            last = {}
            for c in sorted((c for c in held if c[4] <= h), key=order):
                last[c[1]] = c
            held = [c for c in held if c[4] > h or last[c[1]] is c]
        if k < 12:
            marks[0] = max([x for x in [marks[0], *(s[4] for s in bought[k])] if x is not None], default=None)
            marks[1] = max([x for x in [marks[1], *(c[4] for c in changed[k])] if x is not None], default=None)
    assert not waiting
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.select("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op").collect())


@pytest.mark.parametrize(("seed", "n", "m", "clients", "slot_rows", "holes"), [(1, 300, 200, 6, 1 << 16, ((40, 70),)), (2, 250, 250, 3, 20, ())])
def test_enrichment_is_the_simulation(spark, monkeypatch, tmp_path, seed, n, m, clients, slot_rows, holes):
    """The second one with slots so small that clients lie over grids of slots."""
    monkeypatch.setattr(enrichment, "SLOT_ROWS", slot_rows)
    sales, changes = shop(seed, n, m, clients, holes)
    want = simulated(sales, changes)
    spark.createDataFrame(sales, SALES).write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame(changes, CHANGES).write.parquet(f"{tmp_path}/client_changes.parquet")
    got = enrichment.op13_enrichment(spark, str(tmp_path))
    assert rows_of(got) == want
    con = duckdb.connect()
    for t in ("sales", "client_changes"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = con.execute(f"select rec, id, batch, n_held, change_id, balance_cents, op from ({enrichment.OP13_SQL})").fetchall()
    assert Counter(theirs) == want


def test_empty_tables(spark):
    sales, changes = shop(3, 30, 10, 2)
    none = spark.createDataFrame([], CHANGES)
    assert enrichment.enrich(spark.createDataFrame([], SALES), none).count() == 0
    assert rows_of(enrichment.enrich(spark.createDataFrame(sales, SALES), none)) == simulated(sales, [])


def test_last_up_to_is_a_scan():
    rng = np.random.default_rng(5)
    versions = pd.DataFrame({"client": rng.integers(0, 9, 80), "at": rng.integers(-5, 20, 80), "id": rng.integers(0, 4, 80), "has": 15, "op": "U", "cents": 0, "pinned": False})
    versions = enrichment._sorted(versions)
    client, at = rng.integers(-2, 12, 200), rng.integers(-8, 25, 200)
    found = enrichment.last_up_to(versions, client, at)
    for c, t, f in zip(client, at, found, strict=True):
        fits = [i for i, v in versions.iterrows() if v["client"] == c and v["at"] <= t]
        assert f == (fits[-1] if fits else -1)
    assert (enrichment.last_up_to(versions.iloc[:0], client, at) == -1).all()


def test_pruning_leaves_each_clients_last():
    frame = pd.DataFrame([(1, 5, 0), (1, 7, 1), (1, 7, 2), (1, 9, 3), (2, 8, 4), (3, 1, 5)], columns=["client", "at", "id"]).assign(has=15, op="U", cents=0, pinned=False)
    kept = enrichment.pruned(enrichment._sorted(frame), 7)
    assert kept[["id", "pinned"]].to_numpy().tolist() == [[2, True], [3, False], [4, False], [5, True]]
