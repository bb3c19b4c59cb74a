"""Packing token sequences best-two-fit over the length histogram.

A document becomes the ids of its text and an end id; only one that is longer than ``max_tokens`` is cut,
into whole sequences and a rest. A bin is filled greedily: with the longest piece left, then each time with the longest that
still fits. If a gap stays, the bin's smallest piece makes room: of all pairs of unpacked pieces that are together longer than
it and fit the gap it leaves, the longest pair takes its place. Pieces of one length are interchangeable, so
a filled bin is a pattern of lengths that repeats as often as its lengths last, and the pieces are joined back to
the patterns' places by rank.

Scale: texts are tokenized where they are read and are never shuffled. The histogram has at most ``max_tokens`` lengths; each
pattern uses one up but for less than a bin's worth, so the patterns are bounded too, whatever the corpus. A rank is a task's base for the
length, by a prefix sum over the tasks' counts, plus the place within the task: no length, however
common, needs a common task.

Defined cases: null text is the end id alone; rows with one doc_id, or alike in all columns, are packed as rows of their own; ties
between equally long pieces go by task and row; an empty table gives no rows; extra columns, whatever their names, are ignored; very long texts
give many whole sequences and a rest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, tidy
from .packing import PIECE_SCHEMA, _pieces, _placed, places, tokenizer_path

MAX_TOKENS = 2048
END_ID = 0


def _filled(lengths: list[int], left: dict[int, int], max_tokens: int) -> tuple[Counter, int]:
    """A bin's lengths, the longest that fits first, and its gap."""
    bin_, gap, at = Counter(), max_tokens, len(lengths)
    while gap and (at := bisect_right(lengths, gap, 0, at) - 1) >= 0:
        length = lengths[at]
        bin_[length] = min(gap // length, left[length])
        gap -= bin_[length] * length
    return bin_, gap


def _closest_pair(lengths: list[int], free: Counter, above: int, most: int) -> tuple[int, int] | None:
    """The free lengths, one twice if two are left, whose sum is largest among those over above and up to most."""
    low, high, best = 0, bisect_right(lengths, most) - 1, None
    while low <= high:
        a, b = lengths[low], lengths[high]
        if free[a] < 1:
            low += 1
        elif free[b] < 1 or a + b > most or (low == high and free[a] < 2):
            high -= 1
        else:
            if a + b > above:
                above, best = a + b, (a, b)
            low += 1
    return best


def patterns(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths, longest first) of the bins, for a histogram of lengths from 1 to max_tokens."""
    left = {length: n for length, n in histogram.items() if n}
    lengths, out = sorted(left), []
    while lengths:
        bin_, gap = _filled(lengths, left, max_tokens)
        if gap and bin_.total() > 1:
            smallest = min(bin_)
            free = Counter(left)
            free.subtract(bin_)
            if pair := _closest_pair(lengths, free, smallest, gap + smallest):
                bin_.subtract([smallest])
                bin_.update(pair)
        bin_ = +bin_
        count = min(left[length] // n for length, n in bin_.items())
        out.append((count, tuple(sorted(bin_.elements(), reverse=True))))
        for length, n in bin_.items():
            left[length] -= count * n
        lengths = [length for length in lengths if left[length]]
    return out


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    path = path or tokenizer_path()
    ship(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(_pieces, path, max_tokens, end_id), PIECE_SCHEMA)
    pieces = materialize(cut, "best-fit")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    table = places(patterns(histogram, max_tokens))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"))
    placed = ranked.mapInArrow(tidy(_placed, table), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return placed.select("doc_id", F.expr(f"start div {max_tokens}").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in as few sequences of at most 2048 tokens as best-two-fit finds."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
