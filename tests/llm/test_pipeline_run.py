"""The whole pipeline against a brute-force one, and its stages over odd and empty tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sievework.llm import mixing, packing, quality

pipeline = pytest.importorskip("corpus_pipeline")
SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str) -> set:
    w = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_kept(rows: list[tuple]) -> list[tuple]:
    sets, root = [shingles(r[1] or "") for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for x, r in enumerate(rows):
        groups[find(x)].append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and labels of the smallest driver table, and odd ones among them."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*(c.split()[0] for c in SCHEMA.split(", ")))
    first = docs.orderBy("doc_id").first()
    odd = [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, first["text"].replace(" ", "\n", 4), "en", first["source"], 5), (9004, first["text"] + " one more word", "en", "web", None), (9005, "word " * 9000, "en", "web", None)]
    docs.unionByName(spark.createDataFrame(odd, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_is_the_brute_force_pipeline(spark, folder):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    rows = sorted((tuple(r) for r in docs.collect() if scores[r["doc_id"]] >= 0.5), key=lambda r: r[0])
    exact: dict[str, tuple] = {}
    for r in rows:
        exact.setdefault(SPACE.sub(" ", r[1] or ""), r)
    kept = near_kept(list(exact.values()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", kept)
    taken = {i: (size, n) for i, size, n in con.execute(f"select doc_id, size, taken from ({mixing.OP9_SQL})").fetchall()}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text, *_ in kept:
        size, n = taken[i]
        texts = [text] * (n // size) + ([" ".join(WORD.findall(text)[: n % size])] if n % size else []) if n else []
        for t in texts:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
            for s in range(0, len(ids), 4096):
                want[i, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)] += 1
    got = pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    ends = Counter()
    for r in got:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096


def test_stages_over_an_empty_table_and_extra_columns(spark, folder, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, 1, 2), (None, "", 1, 2), (3, "a b", 3, None), (3, "a b", 3, None), (3, "c", 0, 0)], "doc_id long, text string, cls int, score int")
    odd = odd.selectExpr("*", "cast(null as string) AS source")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert out.count() <= 9
