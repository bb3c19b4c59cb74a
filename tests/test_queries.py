"""Every registered query of the library proper against its DuckDB twin, over the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from sievework.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(x):
    if x is None:
        return "-"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, int):
        return str(x) if abs(x) > 10**5 else f"{x:.6g}"
    return str(x)


def bag(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    theirs = duck.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, mine) == bag(columns, theirs.fetchall())
