"""Best-two-fit packing: patterns against their histogram, and an exact round trip of the ids."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import best_fit, packing

SCHEMA = "doc_id long, text string, length string, piece int, rank int"


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_the_histogram_and_few_bins(seed):
    rng = random.Random(seed)
    most = rng.choice([10, 100, 2048])
    histogram = Counter(rng.choice([rng.randint(1, most), rng.randint(1, 1 + most // 9)]) for _ in range(4000))
    found = best_fit.patterns(histogram, most)
    used = Counter()
    for count, pattern in found:
        assert count > 0 and sum(pattern) <= most and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += count
    assert used == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // most)
    bins = sum(count for count, _ in found)
    assert bins <= max(least + 2, 1.01 * least, sum(count for count, _ in packing.patterns(histogram, most)))


def test_two_pieces_take_the_place_of_the_smallest():
    assert best_fit.patterns({6: 1, 3: 1, 2: 2}, 10) == [(1, (6, 2, 2)), (1, (3,))]  # greedily 6, 3; then 3 gives way to 2 and 2
    assert best_fit.patterns({6: 1, 4: 1, 3: 1, 1: 1}, 10) == [(1, (6, 4)), (1, (3, 1))]  # no gap, nothing to replace
    assert best_fit.patterns({7: 1, 2: 1, 1: 1}, 10) == [(1, (7, 2, 1))]
    assert best_fit.patterns({5: 5}, 5) == [(5, (5,))]
    assert best_fit.patterns({1: 10}, 4) == [(2, (1, 1, 1, 1)), (1, (1, 1))]
    assert best_fit.patterns({}, 4) == []


def test_closest_pair_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        free = Counter({rng.randint(1, 20): rng.randint(0, 2) for _ in range(6)})
        above, most = sorted(rng.sample(range(1, 30), 2))
        all_ = [(a, b) for a in free for b in free if a <= b and free[a] > 0 and free[b] > 0 and (a < b or free[a] > 1) and above < a + b <= most]
        got = best_fit._closest_pair(sorted(free), free, above, most)
        assert (got is None) == (not all_)
        if got:
            assert got in all_ and sum(got) == max(map(sum, all_))


def test_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [None, "", "  \t", "été naïve 漢字 don't", *(" ".join(rng.choice(["alpha", "beta", "Gamma", "x1", "été"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)), "word " * 5000, "same text", "same text"]
    rows = [(i if i % 7 else 3, t, "clash", 5, None) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = best_fit.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want, total = Counter(), 0
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert best_fit.pack(spark.createDataFrame([], SCHEMA)).count() == 0
