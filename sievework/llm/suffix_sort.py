"""Sorting suffixes by hash comparisons.

Two suffixes are compared by their longest common extension: prefix polynomial hashes give the hash of any piece of
text in one step, so a binary search over the length finds it in log(limit) probes, and the byte after it decides.
A bottom-up mergesort, vectorised over all groups of a batch, ranks each element of a run in its sibling run by
such comparisons. The polynomial works modulo 2^64, which fixed texts are known to defeat, so every
neighbouring pair of the result is verified byte by byte; a batch with a wrong one is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9FB21C651E98DF25)


class Texts:
    """Bytes with prefix hashes, padded so that reads of ``limit`` bytes never run out."""

    def __init__(self, buf: np.ndarray, limit: int):
        self.limit = limit
        self.buf = np.concatenate([buf, np.zeros(limit + 8, np.uint8)])
        n = len(self.buf)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])
        self.power = power
        words = np.zeros(n - 7, np.uint64)
        for i in range(8):
            words = (words << np.uint64(8)) | self.buf[i : n - 7 + i].astype(np.uint64)
        #: The eight bytes from each place on, as a number in the order of the bytes.
        self.head = words

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to the limit, as the hashes tell it."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.limit, np.int64)
        # hash(a, l) * B^b == hash(b, l) * B^a
        pa, pb = self.prefix[a], self.prefix[b]
        fa, fb = self.power[b], self.power[a]
        for _ in range(int(self.limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa) * fa == (self.prefix[b + mid] - pb) * fb
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a sorts after the one at b within the limit."""
        ext = self.extension(a, b)
        return (ext < self.limit) & (self.buf[a + ext] > self.buf[b + ext])

    def agrees(self, a: np.ndarray, b: np.ndarray, ext: np.ndarray) -> np.ndarray:
        """Whether the first ext bytes are indeed the same, and the next ones rightly ordered."""
        ok = (ext >= self.limit) | (self.buf[a + ext] < self.buf[b + ext])
        for at in range(0, self.limit, 8):
            left = np.clip(ext - at, 0, 8)
            differ = self.head[a + at] ^ self.head[b + at]
            ok &= (left == 0) | ((differ >> (np.uint64(8) * (8 - left).astype(np.uint64) % np.uint64(64))) == 0)
        return ok


def _merge_sort(texts: Texts, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sort ``order`` within the segments that begin at ``first``; runs of one length are merged in all segments at once."""
    segment = np.repeat(np.arange(len(first)), size)
    inside = np.arange(len(order)) - first[segment]
    total = size[segment]
    run, longest = 1, int(size.max(initial=1))
    while run < longest:
        left = (inside // run) % 2 == 0
        begin = first[segment] + inside // (2 * run) * (2 * run)
        middle = np.minimum(begin + run, first[segment] + total)
        end = np.minimum(begin + 2 * run, first[segment] + total)
        # Rank each element in its sibling run: elements of the left run come first among equals.
        low, high = np.where(left, middle, begin), np.where(left, end, middle)
        base = low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            x, y = order[open_], order[mid]
            is_left = left[open_]
            # left: count siblings strictly before x; right: count siblings not after x
            up = np.where(is_left, texts.after(x, y), ~texts.after(y, x))
            low[open_] = np.where(up, mid + 1, low[open_])
            high[open_] = np.where(up, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        own = np.arange(len(order)) - np.where(left, begin, middle)
        out = np.empty_like(order)
        out[begin + own + low - base] = order
        order = out
        run *= 2
    return order


def sort_suffixes(buf: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at ``at``, by group and then by their first ``limit`` bytes, and whether each equals the one before it."""
    if not len(at):
        return at, np.zeros(0, bool)
    texts = Texts(buf, limit)
    head = texts.head[at]
    index = np.lexsort((head, group))
    g, h = group[index], head[index]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(index)))
    # Suffixes that their first eight bytes set apart need no comparison.
    tied = np.flatnonzero(np.repeat(size > 1, size))
    where = index.copy()
    if len(tied):
        many = size > 1
        starts = np.cumsum(size[many]) - size[many]
        place = _merge_sort_index(texts, at, index[tied], starts, size[many])
        where[tied] = place
    a, b = at[where[:-1]], at[where[1:]]
    same_group = ~np.append(True, g[1:] != g[:-1])[1:]
    ext = texts.extension(a, b)
    if not (texts.agrees(a, b, ext) | ~same_group).all():
        return _by_bytes(buf, at, group, limit)
    return where, np.append(False, same_group & (ext >= limit))


def _merge_sort_index(texts: Texts, at: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = _merge_sort(texts, at[index], first, size)
    # Places are distinct, so the sorted places lead back to the indices.
    back = np.argsort(at[index], kind="stable")
    return index[back[np.searchsorted(at[index], order, sorter=back)]]


def _by_bytes(buf: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing the bytes themselves."""
    data = np.concatenate([buf, np.zeros(limit, np.uint8)]).tobytes()
    keys = [(int(g), data[a : a + limit]) for g, a in zip(group.tolist(), at.tolist(), strict=True)]
    where = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    return where, np.array([i > 0 and keys[where[i]] == keys[where[i - 1]] for i in range(len(where))])
