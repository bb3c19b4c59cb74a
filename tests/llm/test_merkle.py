"""The Merkle manifest against a brute-force one and its SQL twin, over few and many partitions, odd rows and tampered texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, run int, level string"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        at = i - i % 3
        yield level[at:i], level[i + 1 : at + 3]
        i //= 3


def brute(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        by[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if tampered else text), doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([r[2] for r in sorted(by[s])]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order]) if order else []
    out = Counter()
    for at, s in enumerate(order):
        for i, r in enumerate(sorted(by[s])):
            path = [*siblings(trees[s], i), *siblings(top, at)]
            proof, got = "", r[3]
            for before, after in path:
                proof += "".join(before + after)
                got = H("".join([*before, got, *after]))
            out[(r[4], r[2], trees[s][-1][0], top[-1][0], H(proof), got, got == top[-1][0])] += 1
    return out


def digests(made):
    out = made.verified().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    made.release()
    return Counter(tuple(r) for r in out)


def tampering(docs):
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))


def sample(n, sources, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(n * 2), rng.choice([None, "", "a\nb\n", "été\n\n漢字", "plain", "x" * 3000 + "\n"]), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 0, -5])) for _ in range(n)]
    return rows + [rows[0]] * 5 + [(None, "no id\n", "en", sources[0], 1), (None, None, None, None, None)]


@pytest.mark.parametrize(("n", "parts", "neighbours", "band"), [(400, 40, 2, 2), (150, 7, 64, 7), (1, 1, 64, 7)])
def test_proofs_are_brute_force(spark, monkeypatch, n, parts, neighbours, band):
    monkeypatch.setattr(merkle, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(merkle, "BAND", band)
    rows = sample(n, ["web", "web", "web", None, "", "Ä", "z", "books", "one"])
    docs = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert digests(tampering(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_sources_and_none(spark):
    rows = [(i, f"t{i}\n", "en", f"host{i % 90}", i) for i in range(200)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    made = tampering(docs)
    assert made.whole.nodes().count() == 30 + 10 + 4 + 2 + 1
    assert digests(made) == brute(rows)
    empty = tampering(spark.createDataFrame([], SCHEMA))
    assert empty.verified().count() == 0 and empty.root().count() == 0


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame([(*r, None, None, None) for r in sample(60, ["a", "b"])], SCHEMA)
    assert {r["verified"] for r in merkle.manifest(docs).verified().collect()} == {True}


@pytest.mark.parametrize("first", range(0, 30, 4))
def test_peaks_carry_from_any_index(first):
    """Two ranges of one tree and the nodes they leave open give the whole tree's nodes."""
    size = 30
    digests_ = [H(str(i)) for i in range(size)]
    want = {(k, i, d) for k, level in enumerate(tree_of(digests_)) for i, d in enumerate(level) if k}
    got, loose = set(), []
    for a, b in ((0, first), (first, size)):
        peaks = merkle.Peaks(size)
        for i in range(a, b):
            got |= {x[1:] for x in peaks.push(0, i, digests_[i])}
        loose += peaks.rest()
    merged = merkle.Peaks(size)
    for level, i, d in sorted(loose, key=lambda x: x[1] * 3 ** x[0]):
        got |= {x[1:] for x in merged.push(level, i, d)}
    assert got == want and not merged.rest()


def test_sql_twin(spark, tmp_path):
    rows = sample(120, ["web", "web", None, "b", "Ä"])
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    got = merkle.op11_manifest(spark, path)
    theirs = con.execute(merkle.OP11_SQL)
    names, want = [d[0] for d in theirs.description], theirs.fetchall()
    assert names == got.columns and len(want) == len(rows)
    assert Counter(map(tuple, got.collect())) == Counter(want)
