"""Packing token sequences shortest-pack-first over the length histogram.

A document becomes the ids of its text and an end id, and is cut into whole sequences of
``max_tokens`` and a rest. Only the number of pieces of each length matters for packing: lengths are
placed longest first, each into the open packs with the least in them (those with the most space
that it fits), and the counts of the packing patterns are updated; a new pack takes as many of the
length as fit. Pieces of one length are interchangeable, so the patterns are joined back by rank: the
r-th piece of a length takes the r-th place that the patterns hold for it.

Scale: texts are tokenized where they are read and are never shuffled. The histogram and the patterns
are bounded by ``max_tokens`` whatever the corpus. A rank is a task's base for the length, by a prefix sum over
the tasks' counts, plus the place within the task, so a length held by a third of all pieces
needs no common task. The pre-tokenizer's
pieces never cross white space, so the ids of a text are those of its pieces in turn; each distinct piece of a
block of text is tokenized once and remembered in a bounded cache.

Defined cases: null text is the end id alone; rows with one doc_id are packed as rows of their own;
an empty table gives no rows; extra columns are ignored; very long texts give many whole sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, chunks, lowered, materialize, ship, tidy, words_of

MAX_TOKENS = 4096
END_ID = 2
#: Words and ids that a worker remembers at most.
CACHE_WORDS = 800_000
CACHE_IDS = 4_000_000
BLOCK = 8 << 20

#: A text with a piece of every kind, by which a vocabulary is tried.
PROBE = "The Quick-brown fox's 12.5 naïve ÉTÉ über!? #tag_x 2024,\t(end) I'll <b> a==b...\nNext  line 漢字 été"

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, place bigint"


def tokenizer_path() -> str:
    """The default vocabulary file, where the machine has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by way of the pieces that the pre-tokenizer cuts.

    In words of ASCII and Latin-1 letters, digits and plain marks, the pieces are runs of letters, single digits and
    runs of marks, in lower case; the model alone tokenizes those. Every other word goes through the whole tokenizer as it stands,
    and so do all texts with a vocabulary for which that isn't so.
    """

    _shared: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.reset()
        # A vocabulary whose pre-tokenizer cuts otherwise goes through the whole tokenizer, text by text.
        self.whole = False
        data = np.frombuffer(PROBE.encode(), np.uint8)
        try:
            got = self.texts(data, np.array([0, len(data)]), 0)[0][:-1].tolist()
        except (KeyError, IndexError, ValueError, OverflowError):
            got = None
        self.whole = got != self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        self.reset()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[i + 1]: end of piece i's ids
        self.used = 0

    def add(self, pieces: list[bytes]) -> None:
        simple = [SIMPLE.fullmatch(x) is not None for x in pieces]
        letters = [x.decode() if x.isascii() else x.decode("latin-1").translate(BYTE_LETTERS) for x, s in zip(pieces, simple, strict=True) if s]
        # The model alone, each piece a word: one call for all of them.
        coded = self.bare.encode(letters, is_pretokenized=True, add_special_tokens=False) if letters else None
        sizes = np.zeros(len(pieces), np.int64)
        ids = np.zeros(0, np.uint32)
        if coded is not None:
            ids = np.array(coded.ids, np.uint32)
            sizes[np.array(simple)] = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(letters))
        if len(letters) < len(pieces):
            others = {i: self.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for i, x in enumerate(pieces) if not simple[i]}
            cuts = np.split(ids, np.cumsum(sizes[np.array(simple)])[:-1]) if letters else []
            rest = iter(cuts)
            parts = [np.array(others[i], np.uint32) if i in others else next(rest) for i in range(len(pieces))]
            ids = np.concatenate(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        new = ids
        count = len(self.known)
        while len(self.ids) < self.used + len(new):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) < count + len(pieces) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(new)] = new
        self.ends[count + 1 : count + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        self.used += len(new)
        self.known.update(zip(pieces, range(count, count + len(pieces)), strict=True))

    def texts(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by the end id, and the rows' offsets."""
        if self.whole:
            view = memoryview(buf.tobytes())
            rows = self.tokenizer.encode_batch([str(view[a:b], "utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)
            each = [np.array([*r.ids, end_id], np.uint32) for r in rows]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.append(0, np.cumsum([len(x) for x in each]))
        if len(self.known) > CACHE_WORDS or self.used > CACHE_IDS:
            self.reset()
        data, bounds, rows = pieces_of(buf, offsets)
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.known
        if new := [w for w in words if w not in known]:
            self.add(new)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        indices = coded.indices.to_numpy(zero_copy_only=False)
        count = sizes[indices]
        before = np.cumsum(count) - count
        ids = self.ids[np.repeat(starts[indices] - before, count) + np.arange(int(count.sum()))]
        at_rows = np.concatenate([before, [len(ids)]])[rows]
        return np.insert(ids, at_rows[1:], end_id), at_rows + np.arange(len(at_rows))


#: Bytes: 0 letter, 1 digit, 2 plain mark, 3 one that sends its word through the whole tokenizer, 4 white space.
#: The apostrophe may begin a contraction, and the less-than sign a special token.
KINDS = np.full(256, 3, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), 0xC3]] = 0
KINDS[SPACES] = 4
KINDS[48:58] = 1
LOWER = lowered(np.arange(256, dtype=np.uint8))
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = 2
SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + n) for n, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def pieces_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' bytes, one after the other, their bounds, and for each row the index of its first piece (with a last one for the end)."""
    kind, low = KINDS[buf], LOWER[buf]
    if len(buf) and buf.max() >= 0x80:
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        byte = buf[second]
        kind[second[(byte >= 0x80) & (byte != 0x97) & (byte != 0xB7)]] = 0
        low[second[(byte >= 0x80) & (byte <= 0x9E) & (byte != 0x97)]] += 32
    solid = kind != 4
    first = np.empty(len(buf), bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == 1
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    first &= solid
    if (kind == 3).any():
        starts, ends, _ = words_of(buf, offsets)
        odd = np.concatenate([[0], np.cumsum(kind == 3)])
        for a, b in zip(*(x[odd[ends] > odd[starts]].tolist() for x in (starts, ends)), strict=True):
            first[a + 1 : b] = False
            low[a:b] = buf[a:b]
    at = np.flatnonzero(first)
    place = np.cumsum(solid)
    total = place[-1:] if len(place) else np.zeros(1, np.int64)
    return low[solid], np.concatenate([place[at] - 1, total]), np.searchsorted(at, offsets)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, max_tokens: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, task = WordIds.of(path), TaskContext.get().partitionId()
    placed = np.zeros(max_tokens + 1, np.int64)
    for batch in batches:
        texts = batch.column(1).fill_null("")
        for a, b, buf, bounds in chunks(texts, BLOCK):
            ids, offsets = encoder.texts(buf, bounds, end_id)
            n = np.diff(offsets)
            parts = -(-n // max_tokens)
            row = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * max_tokens
            length = np.minimum(max_tokens, n[row] - start)
            data = memoryview(ids.astype("<u4").tobytes())
            first = offsets[row] + start
            crc = [zlib.crc32(data[4 * x : 4 * (x + m)]) for x, m in zip(first.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            fresh = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.repeat(fresh, np.diff(np.r_[fresh, len(row)])) + placed[ranked]
            placed += np.bincount(length, minlength=max_tokens + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(np.full(len(row), task, np.int32)), pa.array(place)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"],
            )


def patterns(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns, for a histogram of lengths."""
    spaces: list[int] = []  # with open packs, ascending
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(space: int, count: int, pattern: tuple[int, ...]) -> None:
        if not count:
            return
        if space not in packs:
            packs[space] = []
            insort(spaces, space)
        packs[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        at = len(spaces) - 1
        while left and at >= 0 and spaces[at] >= length:
            space = spaces[at]
            count, pattern = packs[space].pop()
            if not packs[space]:
                del packs[space], spaces[at]
            used = min(count, left)
            left -= used
            put(space, count - used, pattern)
            put(space - length, used, (*pattern, length))
            # Continue with the fullest space at or below this one that still takes the length.
            at = bisect_left(spaces, space + 1) - 1 if used == count else -1
        if left:
            each = max_tokens // length
            put(max_tokens - each * length, left // each, (length,) * each)
            if rest := left % each:
                put(max_tokens - rest * length, 1, (length,) * rest)
    return [(count, pattern) for space in spaces for count, pattern in packs[space]]


def places(found: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: first rank, first sequence and offset of each place that the patterns hold for it, in the order of ranks."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for count, pattern in found:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64).T for k, v in out.items()}


def _placed(batches: Iterator[pa.RecordBatch], table: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        length = column("length").to_numpy(zero_copy_only=False)
        rank = column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            first, base, shift = table[int(length[rows[0]])]
            at = np.searchsorted(first, rank[rows], "right") - 1
            sequence[rows], offset[rows] = base[at] + rank[rows] - first[at], shift[at]
        yield pa.RecordBatch.from_arrays([*(column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    path = path or tokenizer_path()
    ship(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(_pieces, path, max_tokens, end_id), PIECE_SCHEMA)
    pieces = materialize(cut, "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    table = places(patterns(histogram, max_tokens))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(tidy(_placed, table), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
