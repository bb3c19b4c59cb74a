"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles; two link when 100 * intersection >= percent * union. Documents
with one and the same set are a class and are compared once. The join is exact:

1. How many documents hold a token is counted for all tokens, by fingerprints that are sharded by value
   (``repeats``). Tokens in one document alone can't be shared: a set with fewer than ceil(percent n / 100) others links with nothing and goes no further.
2. Tokens are put in a global order, rare ones first. Two sets that link share one of the first
   n - ceil(percent n / 100) + 1 tokens of either, so only classes that share such a token meet.
   Tokens with nearly the same members are one group from there on, so that near copies meet a few times, not once for each token they share.
3. Every class first meets a few pivots of each of its tokens; links found there join near copies into components,
   by a number of comparisons that is linear in the members.
4. Tokens whose members are in several components then get a signature tree each: the leaves are members, with a bitmap
   of their tokens and their size; a node holds the OR of its bitmaps and the range of sizes. The tree is traversed
   against itself from the root; a pair of nodes is dropped if even the largest overlap that bitmaps and
   sizes allow is too small for a link, or if all of both nodes is one component already.
   The token's places in both orders bound the overlap as well: before it, neither set shares anything with the other.
   This is done twice: first a class is given one member of each other component, the one that overlaps most by the bitmaps, and links found so
   join components; then all pairs that are left between components are given.
5. The pairs that remain are compared by fine bitmaps of eight bits a token, which leave few, and those set by set.

Scale: texts are never shuffled; sets are, of classes in remaining pairs alone. The text is read twice, and of the second reading only the
documents that stand for a class with candidates are cut into shingles; they are found by a filter of fixed size (16 MB), which
lets more through when it is full and loses none. A token with more than ``GROUP`` members is cut into bands of sizes, of which only equal and adjacent ones can link, and
bands with more into parts that meet two by two. Links and components stay tables, and tables are deleted once they have been read for the last time.

Shingles are compared by 64-bit hashes of their words, classes by a 128-bit digest of theirs, tokens' lists of members by their length and two 64-bit sums of hashes.

Defined cases: null and empty texts have no shingles and link with nothing, not even each other; with fewer
words than a shingle has, the whole sequence is the one shingle; rows with one doc_id are documents of their
own, and a component is named by its smallest doc_id (null if it has none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, keep_rows, lowered, materialize, mix, release, ship, span_hashes, tidy, words_of
from .components import components
from .repeats import CHUNK_ROWS, CHUNK_SCHEMA, Plan, answers, chunk_rows, groups_of, repeated_items
from .runs import maybe_repeated, repeated_cells, sketched

WORDS, PERCENT = 4, 85
#: Bits of a class's bitmap.
BITS = 1024
#: Members of a token that one traversal holds, members that a task takes at once, node pairs that it looks at in one step.
GROUP, HELD, FRONTIER = 2048, 20000, 1 << 16
#: Pairs in a block of comparisons by fine bitmaps and by sets.
COARSE, PAIRS = 20000, 2000
BLOCK = 1 << 20
#: Cells of each of the two rows of the filter by which documents that stand for a class are found.
FILTER = 1 << 26


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of blocks of rows: their number in the column, the rows' distinct shingle hashes in ascending order, and the rows' offsets in them."""
    for a, b, buf, offsets in chunks(column, BLOCK):
        starts, ends, bounds = words_of(buf, offsets)
        h = span_hashes(lowered(buf), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        grams = gram_hashes(h, words) if len(h) >= words else h[:0]
        own = []
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if y - x >= words:
                own.append(np.unique(grams[x : y - words + 1]))
            elif y > x:
                own.append(mix(gram_hashes(h[x:y], y - x) + np.uint64(y - x)))
            else:
                own.append(grams[:0])
        yield a, np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def _classes(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(flat.astype("<u8").tobytes())
    return [hashlib.blake2b(view[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def bitmaps(prints: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row's bitmap as 64-bit words, and by how much its tokens outnumber its bits."""
    dense = np.zeros((rows, BITS), bool)
    dense[row, (mix(prints) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(dense, axis=1).view(np.uint64), np.bincount(row, minlength=rows) - dense.sum(1)


def fine_bitmap(tokens: np.ndarray) -> bytes:
    """Eight bits or more for each token, a power of two of them, so that a larger bitmap folds to a smaller one's size."""
    size = max(512, 1 << int(8 * len(tokens) - 1).bit_length())
    dense = np.zeros(size, bool)
    dense[(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(dense).tobytes()


def fine_bound(a: np.ndarray, n: int, b: np.ndarray, m: int) -> int:
    """The largest overlap that two fine bitmaps of n and m tokens allow."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    ones = lambda x: int(np.bitwise_count(x).sum())
    return min(n, m, ones(a & b) + min(n - ones(a), m - ones(b)))


def _cut(batches: Iterator[pa.RecordBatch], words: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Chunks of rows, from (doc_id, tag, text): for each row its set's size and class, and the shards' rows of its tokens (shard -1: the rows themselves)."""
    task, serial = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    items = rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        chunk = (task << 32) | serial
        n = np.concatenate([np.diff(x[3]) for x in held])
        doc_ids, tags = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        classes = [c for x in held for c in _classes(x[2], x[3])]
        empty = pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(n), pa.int64()), pa.array([-1] * len(n), pa.int32()), empty, empty, empty, pa.array(np.arange(len(n)), pa.int32()), doc_ids, tags, pa.array(classes, pa.binary()), pa.array(n, pa.int64())],
            names=[*(c.split()[0] for c in CHUNK_SCHEMA.split(", ")), "row", "doc_id", "tag", "cls", "n"],
        )
        shards = chunk_rows(chunk, plan.fingerprints(np.concatenate([x[2] for x in held])), np.repeat(np.arange(len(n)), n), plan)
        none = [pa.nulls(shards.num_rows, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*shards.columns, *none], names=[*shards.schema.names, "row", "doc_id", "tag", "cls", "n"])

    for batch in batches:
        for a, flat, offsets in sets_of(batch.column(2), words):
            k = len(offsets) - 1
            held.append((batch.column(0).slice(a, k), batch.column(1).slice(a, k), flat, offsets))
            items, rows = items + len(flat), rows + k
            if items >= plan.items or rows >= CHUNK_ROWS:
                yield from flush()
                held, items, rows, serial = [], 0, 0, serial + 1
    if held:
        yield from flush()


_CANDIDATE = "cls binary, tag bigint, n bigint, first int, tokens array<bigint>, excess bigint, bits binary, fine binary"


def _candidates(batches: Iterator[pa.RecordBatch], plan: Plan, percent: int) -> Iterator[pa.RecordBatch]:
    """Of a chunk's rows those with enough repeated tokens for a link, with the repeated ones of their prefix in order, ``first`` being the first one's place."""
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    for t in groups_of(batches, ["chunk"]):
        shard, kind = t.column("shard").to_numpy(), t.column("kind").to_numpy()
        rows, homes, found = (t.filter(pa.array(x)) for x in (shard < 0, (shard >= 0) & (kind == 0), kind == 1))
        rows = rows.sort_by("row")
        row, prints, kinds = repeated_items(*(homes.column(c).to_pylist() for c in ("a", "b", "shard")), *(found.column(c).to_pylist() for c in ("a", "b")), plan)
        n = rows.column("n").to_numpy()
        need = -(-percent * n // 100)
        held = np.bincount(row, minlength=len(n))
        able = (n > 0) & (held >= need)
        own = np.flatnonzero(able)
        if not len(own):
            continue
        inside = able[row]
        row, prints, kinds = (np.cumsum(able) - 1)[row[inside]], prints[inside], kinds[inside]
        order = np.lexsort((prints, kinds, row))
        row, prints = row[order], prints[order]
        n, need, held = n[own], need[own], held[own]
        starts = np.cumsum(held) - held
        bits, excess = bitmaps(prints, row, len(own))
        # Tokens that occur once come first, and no one else has them.
        count = held - need + 1
        tokens = [prints[s : s + k].view(np.int64) for s, k in zip(starts.tolist(), count.tolist(), strict=True)]
        fine = [fine_bitmap(prints[s : s + k]) for s, k in zip(starts.tolist(), held.tolist(), strict=True)]
        pick = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("cls").combine_chunks().take(pick),
                rows.column("tag").combine_chunks().take(pick),
                pa.array(n, pa.int64()),
                pa.array(n - held, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(np.concatenate(tokens))),
                pa.array(excess, pa.int64()),
                pa.array([x.tobytes() for x in bits], pa.binary()),
                pa.array(fine, pa.binary()),
            ],
            names=names,
        )


def allowed(i: tuple, j: tuple, percent: int) -> np.ndarray:
    """Whether nodes i and j (bitmap, least size, largest size, excess, component, least place) can hold a pair that links: shared tokens are at most shared bits plus the smaller excess."""
    shared = np.bitwise_count(i[0] & j[0]).sum(1).astype(np.int64) + np.minimum(i[3], j[3])
    shared = np.minimum(shared, np.minimum(i[2], j[2]))
    ok = ((100 + percent) * shared >= percent * (i[1] + j[1])) & (100 * i[2] >= percent * j[1]) & (100 * j[2] >= percent * i[1])
    # What comes before the token isn't shared, if it is the first that is.
    least = -(-percent * (i[1] + j[1]) // (100 + percent))
    return ok & (i[5] <= i[2] - least) & (j[5] <= j[2] - least) & ((i[4] != j[4]) | (i[4] < 0))


class SignatureTrees:
    """Many trees at once. Each level holds all trees' nodes, tree by tree; a node of level l + 1 ORs two of level l, and at the last level every tree is its root."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, n: np.ndarray, excess: np.ndarray, component: np.ndarray, place: np.ndarray):
        self.sizes = [sizes]
        level = (bits, n, n, excess, component, place)
        self.levels, self.offsets = [level], [np.cumsum(sizes) - sizes]
        while self.sizes[-1].max() > 1:
            s, off = self.sizes[-1], self.offsets[-1]
            above = (s + 1) // 2
            start = np.cumsum(above) - above
            tree = np.repeat(np.arange(len(s)), s)
            local = np.arange(int(s.sum())) - off[tree]
            even, odd = np.flatnonzero(local % 2 == 0), np.flatnonzero(local % 2)
            up = start[tree[odd]] + local[odd] // 2
            parts = [x[even].copy() for x in level]
            for i, join in enumerate((np.bitwise_or, np.minimum, np.maximum, np.maximum, lambda x, y: np.where(x == y, x, -1), np.minimum)):
                parts[i][up] = join(parts[i][up], level[i][odd])
            level = tuple(parts)
            self.sizes.append(above)
            self.offsets.append(start)
            self.levels.append(level)

    def pairs(self, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members of the trees left[k] and right[k] (or of one tree, each pair once) that may link and are in different components."""
        top = len(self.levels) - 1
        work = [(top, left, right, np.zeros(len(left), np.int64), np.zeros(len(left), np.int64))]
        while work:
            d, s, t, i, j = work.pop()
            if len(s) > FRONTIER:
                work += [(d, *(x[k : k + FRONTIER] for x in (s, t, i, j))) for k in range(0, len(s), FRONTIER)]
                continue
            a, b = self.offsets[d][s] + i, self.offsets[d][t] + j
            ok = allowed(tuple(v[a] for v in self.levels[d]), tuple(v[b] for v in self.levels[d]), percent)
            if not d:
                ok &= (s != t) | (i < j)
                yield a[ok], b[ok]
                continue
            s, t, i, j = (x[ok] for x in (s, t, i, j))
            if not len(s):
                continue
            s, t = np.repeat(s, 4), np.repeat(t, 4)
            i, j = np.repeat(2 * i, 4) + np.tile([0, 0, 1, 1], len(i)), np.repeat(2 * j, 4) + np.tile([0, 1, 0, 1], len(j))
            inside = (i < self.sizes[d - 1][s]) & (j < self.sizes[d - 1][t]) & ((s != t) | (i <= j))
            work.append((d - 1, *(x[inside] for x in (s, t, i, j))))


def _best(code: np.ndarray, component: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of pairs (i, j) the best one of each class with each other component."""
    kept = np.zeros(len(i), bool)
    for x, y in ((i, j), (j, i)):
        order = np.lexsort((-score, component[y], code[x]))
        new = np.append(True, (np.diff(code[x][order]) != 0) | (np.diff(component[y][order]) != 0))
        kept[order[new[: len(order)]]] = True
    return kept


def _tree_pairs(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that may link, from members in the order of (token, left, right); where left isn't right, only pairs of side 0 with side 1 count.
    Unless every pair is asked for, a class gets the one that overlaps most of each other component."""

    def join(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, left, right, side, n, excess, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "left", "right", "side", "n", "excess", "place"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        component = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        change = lambda *x: np.append(True, np.any([v[1:] != v[:-1] for v in x], axis=0))
        group = np.cumsum(change(token, left, right)) - 1
        order = np.lexsort((bits[:, 1], bits[:, 0], component, n, side, group))
        group, side, itself = group[order], side[order], (left == right)[order]
        starts = np.flatnonzero(change(group, side))
        trees = SignatureTrees(np.diff(np.append(starts, len(group))), bits[order], n[order], excess[order], component[order], place[order])
        own, each, whole = group[starts], side[starts], itself[starts]
        alone = np.flatnonzero(whole)
        two = np.flatnonzero((own[1:] == own[:-1]) & ~whole[1:])
        cls = rows.column("cls").combine_chunks().take(pa.array(order))
        ids = cls.dictionary_encode()
        code, names = ids.indices.to_numpy().astype(np.int64), ids.dictionary
        part, bit, sizes, over = component[order], bits[order], n[order], excess[order]
        seen = np.zeros((0, 2), np.int64)
        scores = np.zeros(0)
        for i, j in trees.pairs(np.append(alone, two), np.append(alone, two + 1), percent):
            seen = np.concatenate([seen, np.stack([i, j], 1)])
            if not every:
                overlap = np.bitwise_count(bit[i] & bit[j]).sum(1) + np.minimum(over[i], over[j])
                scores = np.concatenate([scores, overlap / (sizes[i] + sizes[j])])
                best = _best(code, part, seen[:, 0], seen[:, 1], scores)
                seen, scores = seen[best], scores[best]
        i, j = code[seen[:, 0]], code[seen[:, 1]]
        both = np.unique((np.minimum(i, j) << 32) | np.maximum(i, j))
        both = both[(both >> 32) != (both & 0xFFFFFFFF)]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(both >> 32)), names.take(pa.array(both & 0xFFFFFFFF))], names=["a", "b"])

    held: list[pa.Table] = []
    size = 0
    for t in groups_of(batches, ["token", "left", "right"]):
        held.append(t)
        size += t.num_rows
        if size >= HELD:
            yield from join(pa.concat_tables(held))
            held, size = [], 0
    if held:
        yield from join(pa.concat_tables(held))


def _compare(key: tuple, pairs: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    own = {c: np.frombuffer(t, "<u8") for c, t in zip(sets.column("cls").to_pylist(), sets.column("tokens").to_pylist(), strict=True)}
    a, b = [], []
    for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        u, v = own[x], own[y]
        if len(u) > len(v):
            u, v = v, u
        at = np.searchsorted(v, u)
        at[at == len(v)] = 0
        both = int((v[at] == u).sum())
        if 100 * both >= percent * (len(u) + len(v) - both):
            a.append(x)
            b.append(y)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _coarse(key: tuple, pairs: pa.Table, maps: pa.Table, percent: int) -> pa.Table:
    """``n`` counts a class's repeated tokens, ``whole`` all of them."""
    own = {c: (np.frombuffer(t, np.uint64), n, m) for c, n, m, t in zip(*(maps.column(k).to_pylist() for k in ("cls", "held", "n", "fine")), strict=True)}
    a, b = [], []
    for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        (u, n, whole), (v, m, other) = own[x], own[y]
        if (100 + percent) * fine_bound(u, n, v, m) >= percent * (whole + other):
            a.append(x)
            b.append(y)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _in_blocks(pairs: DataFrame, side: DataFrame, each: int, compare) -> DataFrame:
    """The pairs that compare keeps, block by block. Pairs of near copies are dealt together, those of
    one class with many in parts; a class's row of ``side`` goes to a block once."""
    blocks = max(1, -(-pairs.count() // each))
    if blocks > 1:
        # A pair goes where b's least partner goes, or to one of its parts if more than a quarter of a block goes there.
        home = pairs.groupBy("b").agg(F.min("a").alias("home"), F.count("*").alias("k"))
        parts = home.groupBy("home").agg(F.ceil(4 * F.sum("k") / each).cast("int").alias("parts"))
        pairs = pairs.join(home.drop("k").join(parts, "home"), "b").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")))
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("home", "part"), F.lit(blocks)).cast("int").alias("block"))
    else:
        pairs = pairs.withColumn("block", F.lit(0))
    need = materialize(pairs.select("block", F.explode(F.array("a", "b")).alias("cls")).distinct(), "needed")
    out = materialize(pairs.groupBy("block").cogroup(need.join(side, "cls").groupBy("block")).applyInArrow(compare, "a binary, b binary"), "compared")
    release(need)
    return out


def linked(own: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose sets link: by fine bitmaps first, then by the sets of what those leave."""
    left = _in_blocks(pairs, own.select("cls", "n", (F.col("n") - F.col("first")).alias("held"), "fine"), COARSE, lambda k, x, y: _coarse(k, x, y, percent))
    out = _in_blocks(left, sets, PAIRS, lambda k, x, y: _compare(k, x, y, percent))
    release(left)
    return out


def _sets(docs: DataFrame, own: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) of the classes in ``own``, from the texts of the documents that stand for them; a filter by their tags may let others through."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Twice, since a cell has to count two.
        yield from sketched((np.repeat(mix(batch.column(0).to_numpy().view(np.uint64)), 2) for batch in batches if batch.num_rows), FILTER)

    bits = repeated_cells(own.select("tag").mapInArrow(tidy(mark), "shard int, cells binary"), FILTER)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ok = maybe_repeated(mix(batch.column(0).to_numpy().view(np.uint64)), bits)
            for _, flat, offsets in sets_of(batch.column(1).filter(pa.array(ok)), words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_classes(flat, offsets), pa.binary()), pa.array([flat[a:b].astype("<u8").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=["cls", "tokens"]
                )

    return docs.select("tag", "text").mapInArrow(tidy(wanted), "cls binary, tokens binary")


def _merged(each: DataFrame) -> DataFrame:
    """Members of groups of tokens, from those of each token (token, cls, n, place; k: how many, low and high: their least and greatest hash). Tokens of near copies have
    nearly the same members, and a pair would be met once for each token it shares. Tokens with the same ends and the same length, but for less than a factor of two, are one group,
    with each member's first place in it; where their members are more than twice those of the longest list, they stay on their own."""
    each = each.withColumn("near", F.xxhash64("low", "high", F.floor(F.log2("k"))))
    merged = each.groupBy("near", "cls").agg(F.first("n").alias("n"), F.min("place").alias("place"), F.max("k").alias("k"))
    unlike = merged.groupBy("near").agg(F.count("*").alias("all"), F.max("k").alias("k")).where("all > 2 * k").select("near")
    own = each.join(unlike, "near", "left_semi").select("token", "cls", "n", "place")
    return merged.join(unlike, "near", "left_anti").select(F.col("near").alias("token"), "cls", "n", "place").unionByName(own)


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether the sizes, and the places of a first shared token, of two members allow a link."""
    least = lambda x: (100 + percent) * (x["n"] - x["place"]) >= percent * (a["n"] + b["n"])
    return (100 * a["n"] >= percent * b["n"]) & (100 * b["n"] >= percent * a["n"]) & least(a) & least(b)


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every member of a token with a few of the token's members, its pivots, where they are in other components."""
    own = F.struct("n", "place", "cls", "component")
    h = F.xxhash64("cls")
    pivots = members.groupBy("token").agg(F.min_by(own, h).alias("p1"), F.max_by(own, h).alias("p2"), F.min_by(own, "n").alias("p3"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    both = members.join(pivots.where("c1 <> c2").select("token", F.array("p1", "p2", "p3").alias("pivots")), "token").select(own.alias("x"), F.explode("pivots").alias("y"))
    both = both.where((F.col("x.component") != F.col("y.component")) & _may_link(F.col("x"), F.col("y"), percent))
    return both.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def _dealt(members: DataFrame, group: int, percent: int) -> DataFrame:
    """Members of tokens in several components, dealt to traversals (token, left, right): a token alone, or two of its blocks where it has more than ``group`` members."""
    agg = members.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("members")).where("c1 <> c2").select("token", "members")
    found = members.join(agg, "token")
    zero = F.lit(0).cast("bigint")
    small = found.where(F.col("members") <= group).drop("members").withColumns({"left": zero, "right": zero, "side": F.lit(0)})
    # Sizes of a link differ by no more than one band, which is a little wider than it need be.
    band = F.floor(F.log("n") / float(-np.log(percent / 100 - 0.005))).cast("int")
    large = found.where(F.col("members") > group).drop("members").withColumn("band", band)
    blocks = large.groupBy("token", "band").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    large = large.join(blocks, ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
    each = blocks.select("token", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    place = lambda b, p: F.col(b).cast("bigint") * (1 << 32) + F.col(p)
    other = each.select("token", F.col("band").alias("band2"), F.col("part").alias("part2"))
    meet = each.join(other, "token").where("band2 = band AND part2 >= part OR band2 = band + 1")
    meet = meet.select("token", "band", "part", "band2", "part2", place("band", "part").alias("left"), place("band2", "part2").alias("right"))
    one = large.join(meet.drop("band2", "part2"), ["token", "band", "part"]).withColumn("side", F.lit(0))
    two = large.join(meet.where("left <> right").select("token", F.col("band2").alias("band"), F.col("part2").alias("part"), "left", "right"), ["token", "band", "part"]).withColumn("side", F.lit(1))
    return small.unionByName(one.unionByName(two).drop("band", "part"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, tag, n_shingles, component_id and the root class of every row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("tag"))
    plan = Plan.of(docs)
    schema = f"{CHUNK_SCHEMA}, row int, doc_id bigint, tag bigint, cls binary, n bigint"
    cut = materialize(docs.select("doc_id", "tag", "text").mapInArrow(tidy(_cut, words, plan), schema), "chunks")
    rows = cut.where("shard < 0").select("chunk", "row", "doc_id", "tag", "cls", "n")
    none = {c: F.lit(None).cast(t) for c, t in (("a", "binary"), ("b", "binary"), ("row", "int"), ("tag", "bigint"), ("cls", "binary"), ("n", "bigint"))}
    home = cut.select("chunk", "shard", F.lit(0).alias("kind"), F.col("counts").alias("a"), F.col("rows").alias("b"), "row", "tag", "cls", "n")
    found = materialize(answers(cut, plan), "answers")
    found_rows = found.select("chunk", "shard", F.lit(1).alias("kind"), F.col("marks").alias("a"), F.col("repeated").alias("b"), *(none[c].alias(c) for c in ("row", "tag", "cls", "n")))
    together = home.unionByName(found_rows).repartition("chunk").sortWithinPartitions("chunk", "shard")
    able = materialize(together.mapInArrow(tidy(_candidates, plan, percent), _CANDIDATE).dropDuplicates(["cls"]), "able")
    rows = materialize(rows.select("doc_id", "tag", "cls", "n"), "rows")
    release(cut, found)

    place = able.select("cls", "n", "first", F.posexplode("tokens").alias("at", "token")).groupBy("token", "cls").agg(F.first("n").alias("n"), F.min(F.col("first") + F.col("at")).alias("place"))
    place = materialize(place, "tokens")
    # Of tokens with the same members one does, the first in the order: what shares one of them shares it.
    same = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"x{i}") for i in range(2)]
    h = F.xxhash64("cls")
    lists = place.groupBy("token").agg(F.count("*").alias("k"), F.sum("place").alias("places"), F.min(h).alias("low"), F.max(h).alias("high"), *same).where("k > 1")
    several = lists.groupBy("k", "x0", "x1", "low", "high").agg(F.min_by("token", F.struct("places", "token")).alias("token")).select("token", "k", "low", "high")
    each = materialize(place.join(several, "token"), "lists")
    members = materialize(_merged(each), "members")
    release(each)
    own = materialize(able.join(members.select("cls").distinct(), "cls", "left_semi").drop("tokens"), "signatures")
    release(place, able)
    sets = materialize(_sets(docs, own, words), "sets")

    links, known = None, None
    for step in ("pivots", "best", "every"):
        if known is None:
            at = members.withColumn("component", F.col("cls"))
        else:
            at = members.join(known, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "place", F.coalesce("root", "cls").alias("component"))
        at = materialize(at, "placed")
        if step == "pivots":
            pairs = _pivot_pairs(at, percent)
        else:
            dealt = _dealt(at, GROUP, percent).join(own.select("cls", "excess", "bits"), "cls").repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
            names = ("token", "left", "right", "side", "cls", "n", "place", "component", "excess", "bits")
            pairs = dealt.select(*names).mapInArrow(tidy(_tree_pairs, percent, step == "every"), "a binary, b binary").distinct()
        pairs = materialize(pairs, "pairs")
        if links is not None and pairs.isEmpty():
            release(at, pairs)
            continue
        more = linked(own, sets, pairs, percent)
        if links is not None and more.isEmpty():
            release(at, pairs, more)
            continue
        before = [x for x in (links, known) if x is not None]
        links = more if links is None else materialize(links.unionByName(more), "links")
        known = materialize(components(links), "components")
        release(at, pairs, *before, *([more] if before else []))
    release(members, own, sets, links)

    rooted = rows.join(known, F.col("cls") == F.col("node"), "left").select("doc_id", "tag", "n", F.coalesce("root", "cls").alias("root"))
    rooted = materialize(rooted, "rooted")
    names = materialize(rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"), "names")
    release(rows, known)
    return rooted.join(names, (rooted["root"] == names["root"]) & (F.col("n") > 0), "left").select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), rooted["root"]
    )


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when one document of each component does, that with the smallest doc_id; those without shingles all stay."""
    found = materialize(jaccard_components(docs, words, percent), "joined")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tag"))
    chosen = found.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("doc_id"), F.col("x.tag").alias("tag"))
    return keep_rows(docs, chosen.unionByName(found.where("n_shingles = 0").select("doc_id", "tag")))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its set's size and its component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS s FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reached (doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(w.doc_id, (SELECT min(other) FROM reached r WHERE r.doc_id = w.doc_id)), w.doc_id) AS component_id
FROM words w LEFT JOIN sizes z ON w.doc_id = z.doc_id
"""
