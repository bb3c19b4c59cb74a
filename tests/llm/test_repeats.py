"""Sharded counting of fingerprints, many signature trees at once, and sketches that grow with the corpus."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sievework.llm import jaccard, repeats, runs
from sievework.llm.common import mix


def test_numbers_survive_packing():
    for x in ([], [0], [255], [256, 3], [1 << 40, 0], [(1 << 64) - 1]):
        assert repeats.unpack(repeats.pack(np.array(x, np.uint64))).tolist() == x


@pytest.mark.parametrize(("bits", "shard_bits"), [(20, 3), (48, 0), (60, 4)])
def test_repeated_items_of_chunks(bits, shard_bits):
    """What chunks get back is what counting all items gives, whatever the shards."""
    rng = np.random.default_rng(2)
    plan = repeats.Plan(bits, shard_bits, 1 << 19)
    chunks = []
    for _ in range(4):
        h = mix(rng.integers(0, 700, 300).astype(np.uint64))
        chunks.append((plan.fingerprints(h), np.sort(rng.integers(0, 40, 300))))
    total = Counter(p for prints, _ in chunks for p in prints.tolist())
    sent = [repeats.chunk_rows(i, prints, row, plan) for i, (prints, row) in enumerate(chunks)]
    table = pa.Table.from_batches(sent).sort_by("shard")
    back = pa.Table.from_batches(repeats._answers(iter(table.to_batches(max_chunksize=3)), plan))
    for i, (prints, row) in enumerate(chunks):
        own, got = (t.filter(pc.equal(t.column("chunk"), i)).sort_by("shard") for t in (table, back))
        assert own.column("shard").to_pylist() == got.column("shard").to_pylist()
        r, p, k = repeats.repeated_items(*(own.column(c).to_pylist() for c in ("counts", "rows", "shard")), *(got.column(c).to_pylist() for c in ("marks", "repeated")), plan)
        want = Counter((int(a), int(b)) for a, b in zip(row, prints, strict=True) if total[int(b)] > 1)
        assert Counter(zip(r.tolist(), p.tolist(), strict=True)) == want
        assert all(int(c) == int(repeats.count_class(np.array([total[int(x)]]))[0]) for x, c in zip(p, k, strict=True))


def test_groups_across_batches():
    t = pa.table({"a": [1, 1, 1, 2, 2, 3, 3, 3, 3, 4], "b": [0, 0, 1, 1, 1, 1, 1, 1, 2, 2]})
    for size in (1, 2, 3, 10):
        got = [(g.column("a")[0].as_py(), g.column("b")[0].as_py(), g.num_rows) for g in repeats.groups_of(iter(t.to_batches(max_chunksize=size)), ["a", "b"])]
        assert got == [(1, 0, 2), (1, 1, 1), (2, 1, 2), (3, 1, 3), (3, 2, 1), (4, 2, 1)]


def test_trees_drop_no_pair_that_links():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 5000, 60) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 5000, 60), base[i % 6])) for i in range(120)]
    flat, row = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(120), [len(s) for s in sets])
    bits, excess = jaccard.bitmaps(flat, row, 120)
    n = np.array([len(s) for s in sets])
    sizes = np.array([50, 1, 30, 39])
    trees = jaccard.SignatureTrees(sizes, bits, n, excess, np.arange(120), np.zeros(120, np.int64))
    starts = np.cumsum(sizes) - sizes
    for left, right in ((0, 0), (2, 2), (0, 3), (1, 2), (1, 1)):
        got = {(int(a), int(b)) for i, j in trees.pairs(np.array([left]), np.array([right]), 80) for a, b in zip(i, j, strict=True)}
        for a in range(starts[left], starts[left] + sizes[left]):
            for b in range(starts[right], starts[right] + sizes[right]):
                both = len(np.intersect1d(sets[a], sets[b]))
                if (left != right or a < b) and 100 * both >= 80 * (n[a] + n[b] - both):
                    assert (a, b) in got


def test_bands_and_parts_lose_no_link(spark):
    """A token with more members than a traversal holds: near sizes in bands, and bands in parts."""
    rng = np.random.default_rng(6)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = [w if rng.random() > 0.02 else f"x{rng.integers(1 << 30)}" for w in common[: int(rng.integers(40, 61))]]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df, 2, 70).collect())
    held = jaccard.GROUP
    try:
        jaccard.GROUP = 9
        assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df, 2, 70).collect()) == want
    finally:
        jaccard.GROUP = held
    assert len({c for _, c in want}) < 160


def test_prints_and_rows_take_few_bits():
    """Near what their distances ask for, not a whole number of bytes that the largest distance sets."""
    rng = np.random.default_rng(8)
    plan = repeats.Plan(40, 2, 1 << 19)
    prints = np.unique(rng.integers(0, 1 << 40, 20000).astype(np.uint64))
    for x in (prints, np.append(prints, prints)):
        sent = repeats.chunk_rows(0, x, np.arange(len(x)) % 1100, plan)
        assert 8 * sum(map(len, sent.column("prints").to_pylist())) < len(prints) * (np.log2((1 << 40) / len(prints)) + 3)
        assert 8 * sum(map(len, sent.column("rows").to_pylist())) < len(x) * 11.1
    back = pa.Table.from_batches(repeats._answers(iter([sent]), plan))
    assert 8 * sum(map(len, back.column("repeated").to_pylist())) < len(prints) * (np.log2((1 << 40) / len(prints)) + 3)
    for base in (0, 7 << 40):
        for y in ([], [0], [5], [0, 1, 2, 3], [0, 1 << 50], [1 << 61]):
            y = np.array(y, np.uint64) + np.uint64(base)
            assert repeats.unpack_sorted(repeats.pack_sorted(y, base), base).tolist() == y.tolist()
    for y in ([], [0], [0, 0], [3], [255, 1], [1 << 40, 0]):
        assert repeats.unpack_bits(repeats.pack_bits(np.array(y, np.int64))).tolist() == y


def _kept_tables(monkeypatch, name):
    """Rows of the tables that jaccard writes under that name."""
    kept, write = [], jaccard.materialize

    def materialize(df, n):
        out = write(df, n)
        if n == name:
            kept.append(out.collect())
        return out

    monkeypatch.setattr(jaccard, "materialize", materialize)
    return kept


def test_near_copies_meet_a_few_times(spark, monkeypatch):
    """Not once for each token that they share; and copies of several texts, some of which link and some don't, lose no link."""
    rng = np.random.default_rng(9)
    base = [[f"w{b}x{i}" for i in range(160)] for b in range(3)]
    rows = []
    for i in range(120):
        words = list(base[i % 3])
        for at in rng.choice(160, int(rng.integers(1, 5)), replace=False):
            words[at] = f"y{rng.integers(1 << 30)}"
        rows.append((i, " ".join(words)))
    kept = _kept_tables(monkeypatch, "members")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert got == dict(enumerate(root))
    assert 3 < len(set(root)) < 120
    groups = {}
    for r in kept[0]:
        groups.setdefault(r["token"], []).append(bytes(r["cls"]))
    met = Counter((a, b) for g in groups.values() for a in g for b in g if a < b)
    assert sum(met.values()) < 8 * len(met)


def test_tokens_with_unlike_members_stay_alone(spark):
    """Lists with the same ends and about the same length, but little else in common, aren't made one large group."""
    like = [(0, [1, 2, 3, 4, 9]), (1, [1, 2, 3, 5, 9])]
    unlike = [(10 + i, [100, 199, *range(110 + 3 * i, 113 + 3 * i)]) for i in range(6)]
    rows = [(t, c.to_bytes(2, "big"), 50, i, len(g), min(g), max(g)) for t, g in like + unlike for i, c in enumerate(g)]
    got = jaccard._merged(spark.createDataFrame(rows, "token long, cls binary, n long, place int, k long, low long, high long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["token"], {})[int.from_bytes(r["cls"], "big")] = r["place"]
    assert {t: set(g) for t, g in groups.items() if t in dict(unlike)} == {t: set(g) for t, g in unlike}
    assert [g for t, g in groups.items() if t not in dict(unlike)] == [{1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 9: 4}]


def test_a_set_goes_to_few_blocks(spark, monkeypatch):
    """Pairs of near copies are compared in one block, or in its parts where they are many."""
    pairs = [(f"{c:03d}{a:03d}".encode(), f"{c:03d}{b:03d}".encode()) for c in range(40) for b in range(6) for a in range(b)]
    pairs += [(b"900000", f"9{b:05d}".encode()) for b in range(1, 400)]
    own = sorted({x for p in pairs for x in p})
    side = spark.createDataFrame([(x, int(x)) for x in own], "cls binary, v long")
    kept = _kept_tables(monkeypatch, "needed")

    def compare(key, pairs, side):
        assert set(pairs.column("a").to_pylist()) | set(pairs.column("b").to_pylist()) == set(side.column("cls").to_pylist())
        return pairs.select(["a", "b"])

    got = jaccard._in_blocks(spark.createDataFrame(pairs, "a binary, b binary"), side, 50, compare).collect()
    assert sorted((bytes(r["a"]), bytes(r["b"])) for r in got) == sorted(pairs)
    assert len(kept[0]) < 1.5 * len(own)
    assert max(Counter(r["block"] for r in kept[0]).values()) < 200


def test_minima_fill_all_shards_alike_and_sketches_grow(spark):
    keys = np.sort(mix(np.arange(400000, dtype=np.uint64)).reshape(-1, 100), axis=1)[:, 0]
    count = 1 << 20
    for c in runs.cells(keys, count):
        share = np.bincount(c // (count // runs.SHARDS), minlength=runs.SHARDS)
        assert share.max() < 2 * share.mean()
    assert runs.cells_for(spark.createDataFrame([("a" * 100,)], "text string"), 8) == runs.FEWEST
    big = spark.range(40).selectExpr("repeat('x', 1000000) AS text")
    assert runs.cells_for(big, 8) == 1 << 23


def test_components_go_on_until_nothing_changes(spark):
    from sievework.llm.components import components

    # A long path whose names alternate, so that every round has work.
    names = [i // 2 if i % 2 else 999 - i // 2 for i in range(400)]
    links = spark.createDataFrame(list(zip(names[:-1], names[1:], strict=True)), "a long, b long")
    assert {r["root"] for r in components(links).collect()} == {min(names)}
