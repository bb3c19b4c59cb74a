"""Windows grouped into runs by their smallest gram, and a count-min sketch of the runs' grams.

A window of ``width`` items holds ``width - gram + 1`` grams. Consecutive windows whose smallest gram hash stands
at the same place form a run. Two windows with the same items have their smallest gram at the same
place within, hence the same gram: whatever repeats, repeats within one gram's runs. So the gram's hash is a
key for exact grouping that takes one row a run, not one a window, and the number of a gram's runs is never
less than the number of any of its windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tidy

#: Rows of a sketch, parts of a row that merge on their own, and the fewest and most cells of a row.
DEPTH, SHARDS, FEWEST, MOST = 2, 64, 1 << 20, 1 << 28
#: Low bits of a key that hold a place within the block of text.
PLACE_BITS = 24
#: Cells that a task holds before it hands them on.
HELD = 1 << 21


class Packed:
    """An array that travels to the workers compressed: sketches of small inputs are mostly zeros."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __getstate__(self) -> tuple:
        return zlib.compress(self.array.tobytes(), 1), self.array.dtype.str, self.array.shape

    def __setstate__(self, state: tuple) -> None:
        data, kind, shape = state
        self.array = np.frombuffer(zlib.decompress(data), kind).reshape(shape)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, by doubling."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n]) if size < w else x[:n]


def window_runs(grams: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window's start, number of windows, gram hash) of every run. ``grams`` holds a hash for each item's
    gram, ``bounds`` the rows' item offsets; windows and grams stay within a row."""
    empty = np.zeros(0, np.int64)
    if len(grams) >= 1 << PLACE_BITS:
        # A row too long for the places of one block: go through it in pieces that share all but one item of a window.
        step, parts = (1 << PLACE_BITS) - width - gram, []
        for row in range(len(bounds) - 1):
            for a in range(int(bounds[row]), max(int(bounds[row]) + 1, int(bounds[row + 1]) - width + 1), step):
                b = min(a + step + width - 1, int(bounds[row + 1]))
                _, start, n, h = window_runs(grams[a : b - gram + 1], np.array([0, b - a]), width, gram)
                parts.append((np.full(len(start), row), start + a, n, h))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty, empty, empty, grams[:0])
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(keys, width - gram + 1) & low).astype(np.int64)
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    rows = np.flatnonzero(count)
    if not len(rows) or not len(place):
        return empty, empty, empty, grams[:0]
    begin = np.ones(len(place), bool)
    begin[1:] = place[1:] != place[:-1]
    begin[bounds[rows]] = True
    inside = np.zeros(len(place) + 1, np.int64)
    np.add.at(inside, bounds[rows], 1)
    np.add.at(inside, bounds[rows] + count[rows], -1)
    inside = np.cumsum(inside[:-1]) > 0
    start = np.flatnonzero(begin & inside)
    row = np.searchsorted(bounds, start, "right") - 1
    # An empty row shares its offset with the next one; the last of them holds the items.
    end = np.minimum(np.append(start[1:], len(place)), (bounds[:-1] + count)[row])
    return row, start, end - start, grams[place[start]]


def cells_for(docs: DataFrame, each: int) -> int:
    """Cells of a sketch row for a corpus: a power of two, one for every ``each`` bytes of text, up to a bound of what a worker holds (32 MB a row)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST, max(FEWEST, 1 << (size // each).bit_length()))


def cells(h: np.ndarray, count: int) -> list[np.ndarray]:
    """The cell of each hash in each sketch row. Keys that are minima of hashes have few high bits, hence the mixing."""
    h = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    return [((h >> np.uint64(32 * i)) & np.uint64(count - 1)).astype(np.int64) for i in range(DEPTH)]


def _hand_on(held: list[np.ndarray], depth: int, count: int) -> Iterator[pa.RecordBatch]:
    own = np.sort(np.concatenate(held))
    shard = count // SHARDS
    cuts = np.searchsorted(own, np.arange(0, count + 1, shard))
    # Two of a cell say as much as more of them.
    twice = np.ones(len(own), bool)
    twice[2:] = own[2:] != own[:-2]
    data = [(own[a:b][twice[a:b]] % shard).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARDS) + depth * SHARDS, pa.int32()), pa.array(data, pa.binary())], names=["shard", "cells"])


def sketched(hashes: Iterator[np.ndarray], count: int) -> Iterator[pa.RecordBatch]:
    """A task's part of the sketch: its runs' cells by shard, each twice at most."""
    held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    size = 0
    for h in hashes:
        for i, c in enumerate(cells(h, count)):
            held[i].append(c)
        size += len(h)
        if size >= HELD:
            for i in range(DEPTH):
                yield from _hand_on(held[i], i, count)
            held, size = [[] for _ in range(DEPTH)], 0
    if size:
        for i in range(DEPTH):
            yield from _hand_on(held[i], i, count)


def _merged(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            c = np.frombuffer(data.as_buffer(), "<u4")
            counts = seen.setdefault(shard, np.zeros(count // SHARDS, np.uint8))
            again = c[1:][c[1:] == c[:-1]]
            counts[again] = 2
            once = c[np.append(True, c[1:] != c[:-1])] if len(c) else c
            counts[once] = np.minimum(counts[once] + 1, 2)
    for shard, counts in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["shard", "bits"])


def repeated_cells(parts: DataFrame, count: int) -> Packed:
    """For each sketch row the packed bits of the cells that count two or more: DEPTH * count / 8 bytes."""
    rows = parts.repartition(SHARDS, "shard").mapInArrow(tidy(_merged, count), "shard int, bits binary").collect()
    out = np.zeros((DEPTH * SHARDS, count // SHARDS // 8), np.uint8)
    for r in rows:
        out[r["shard"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Packed(out.reshape(DEPTH, -1))


def maybe_repeated(h: np.ndarray, bits: Packed) -> np.ndarray:
    """Whether the sketch counts each hash twice or more; never false for one that is."""
    ok = np.ones(len(h), bool)
    for row, c in zip(bits.array, cells(h, 8 * bits.array.shape[1]), strict=True):
        ok &= (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return ok
