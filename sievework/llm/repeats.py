"""Which items of a corpus stand in it more than once: counts of fingerprints, sharded by their value.

Every task cuts its rows into chunks and sorts a chunk's item fingerprints. For each shard of the fingerprints' range
a chunk sends one row of distinct fingerprints and their counts. A shard's merge adds the counts up and answers every
chunk with a class for each of its fingerprints: 0 for one that occurs once in the corpus, else a byte
that grows with the logarithm of the count. Nothing is broadcast or collected; a
fingerprint reaches its shard once a chunk, however frequent it is.

A fingerprint has so many bits that there are at least ten values for each item of the corpus: few items that occur once
look repeated, at any size, and none that repeats looks single. Sorted fingerprints are held in two bits more than the logarithm of their mean distance, rows' numbers in as many bits as a chunk has need of.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Bytes of text a shard, as a power of two, and the most shards, as another: beyond them shards grow, to 60 million fingerprints at 100 TB.
SHARD_TEXT, MOST_SHARDS = 23, 18
#: Items and rows of a chunk.
CHUNK_ITEMS, CHUNK_ROWS = 1 << 19, 1 << 16


@dataclass(frozen=True)
class Plan:
    """Bits of a fingerprint, and the shards and items a chunk, which follow from the size of the corpus."""

    bits: int
    shard_bits: int
    items: int

    @classmethod
    def of(cls, docs: DataFrame) -> Plan:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shard_bits = min(MOST_SHARDS, max(0, (size >> SHARD_TEXT).bit_length()))
        # Every row for a shard holds some dozens of fingerprints at least.
        return cls(max(16, size.bit_length() + 1), shard_bits, max(CHUNK_ITEMS, 64 << shard_bits))

    def fingerprints(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest width that holds them, the width first."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _low_bits(x: np.ndarray, width: int) -> np.ndarray:
    size = next(s for s in (2, 4, 8) if width <= 8 * s)
    return np.packbits(np.unpackbits(x.astype(f">u{size}").view(np.uint8).reshape(-1, size), axis=1)[:, 8 * size - width :])


def _from_low_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    size = next(s for s in (2, 4, 8) if width <= 8 * s)
    bits = np.zeros((n, 8 * size), np.uint8)
    bits[:, 8 * size - width :] = np.unpackbits(data, count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(f">u{size}").ravel().astype(np.uint64)


def pack_bits(x: np.ndarray) -> bytes:
    """Unsigned numbers in as many bits each as the largest needs; their count and that width first."""
    width = int(x.max()).bit_length() if len(x) else 0
    return len(x).to_bytes(4, "little") + bytes([width]) + _low_bits(x, width).tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    return _from_low_bits(np.frombuffer(data, np.uint8, offset=5), int.from_bytes(data[:4], "little"), data[4])


def pack_sorted(x: np.ndarray, base: int) -> bytes:
    """Ascending numbers from base on, as low bits and the high bits' differences in unary (Elias-Fano): some two bits more each than the logarithm of their mean distance, however uneven the distances are."""
    x = x - np.uint64(base)
    n, most = len(x), int(x[-1]) if len(x) else 0
    width = max(0, (most // max(1, n)).bit_length() - 1)
    high = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    unary[high] = 1
    return n.to_bytes(4, "little") + bytes([width]) + _low_bits(x, width).tobytes() + np.packbits(unary).tobytes()


def unpack_sorted(data: bytes, base: int) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    cut = -(-n * width // 8)
    rest = np.frombuffer(data, np.uint8, offset=5)
    high = np.flatnonzero(np.unpackbits(rest[cut:])) - np.arange(n)
    return ((high.astype(np.uint64) << np.uint64(width)) | _from_low_bits(rest[:cut], n, width)) + np.uint64(base)


#: A chunk's row for a shard: distinct fingerprints, how often each occurs, and the chunk's rows that hold them.
CHUNK_SCHEMA = "chunk bigint, shard int, prints binary, counts binary, rows binary"


def chunk_rows(chunk: int, prints: np.ndarray, row: np.ndarray, plan: Plan) -> pa.RecordBatch:
    """The shards' rows of a chunk, from each item's fingerprint and row number."""
    row_bits = max(1, int(row.max()).bit_length()) if len(row) else 1
    if plan.bits + row_bits <= 64:
        key = np.sort((prints << np.uint64(row_bits)) | row.astype(np.uint64))
        prints, row = key >> np.uint64(row_bits), key & np.uint64((1 << row_bits) - 1)
    else:
        order = np.lexsort((row, prints))
        prints, row = prints[order], row[order]
    new = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    distinct, counts = prints[new], np.diff(np.append(new, len(prints)))
    step = plan.bits - plan.shard_bits
    cuts = np.append(np.searchsorted(distinct, np.arange(1 << plan.shard_bits, dtype=np.uint64) << np.uint64(step)), len(distinct))
    at = np.append(new, len(prints))[cuts]
    full = np.flatnonzero(np.diff(cuts)).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * len(full), pa.int64()),
            pa.array(full, pa.int32()),
            pa.array([pack_sorted(distinct[cuts[s] : cuts[s + 1]], s << step) for s in full], pa.binary()),
            pa.array([zlib.compress(pack(counts[cuts[s] : cuts[s + 1]]), 1) for s in full], pa.binary()),
            pa.array([pack_bits(row[at[s] : at[s + 1]]) for s in full], pa.binary()),
        ],
        names=["chunk", "shard", "prints", "counts", "rows"],
    )


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn, from rows sorted by the key's columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names])
        if held and [held[0].column(n)[0].as_py() for n in names] != keys[:, 0].tolist():
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield pa.Table.from_batches(held)


def count_class(total: np.ndarray) -> np.ndarray:
    """0 for a count of one, else a byte that grows by four with each doubling."""
    return np.where(total > 1, np.minimum(255, 1 + 4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)


def _answers(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    step = plan.bits - plan.shard_bits
    for rows in groups_of(batches, ["shard"]):
        shard = rows.column("shard")[0].as_py()
        own = [unpack_sorted(x, shard << step) for x in rows.column("prints").to_pylist()]
        counts = np.concatenate([unpack(zlib.decompress(x)) for x in rows.column("counts").to_pylist()]).astype(np.int64)
        every = np.concatenate(own)
        order = np.argsort(every)
        ranked = every[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        found = np.empty(len(every), np.uint8)
        found[order] = np.repeat(count_class(np.add.reduceat(counts[order], new)), np.diff(np.append(new, len(every))))
        ends = np.cumsum([len(x) for x in own]).tolist()
        marks = [found[b - len(x) : b] for x, b in zip(own, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("chunk").combine_chunks(),
                pa.array([shard] * len(own), pa.int32()),
                pa.array([zlib.compress(m.tobytes(), 1) for m in marks], pa.binary()),
                pa.array([pack_sorted(x[m > 0], shard << step) for x, m in zip(own, marks, strict=True)], pa.binary()),
            ],
            names=["chunk", "shard", "marks", "repeated"],
        )


def answers(chunks: DataFrame, plan: Plan) -> DataFrame:
    """(chunk, shard, marks, repeated): the class of each distinct fingerprint, and the fingerprints that repeat."""
    asked = chunks.where("shard >= 0").select("chunk", "shard", "prints", "counts")
    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_answers, plan), "chunk bigint, shard int, marks binary, repeated binary")


def repeated_items(counts: list[bytes], rows: list[bytes], shards: list[int], marks: list[bytes], repeated: list[bytes], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, class) of a chunk's items that repeat, from its rows and answers, which stand in the order of their shards."""
    step = plan.bits - plan.shard_bits
    row, prints, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for c, r, s, m, p in zip(counts, rows, shards, marks, repeated, strict=True):
        times, mark = unpack(zlib.decompress(c)).astype(np.int64), np.frombuffer(zlib.decompress(m), np.uint8)
        often = mark > 0
        if often.any():
            row.append(unpack_bits(r)[np.repeat(often, times)].astype(np.int64))
            prints.append(np.repeat(unpack_sorted(p, s << step), times[often]))
            kind.append(np.repeat(mark[often], times[often]))
    return np.concatenate(row), np.concatenate(prints), np.concatenate(kind)
