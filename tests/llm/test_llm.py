"""The ten operators against brute force and oracles, on small fixtures with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import ann, exact_dedup, jaccard, language_id, license_scan, mixing, packing, quality, registry, suffix_dedup, suffix_sort, substring_dedup
from sievework.llm.common import chunks, gram_hashes
from sievework.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, cls int, size int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return [rng.choice(["alpha", "beta", "Gamma", "delta,", "été", "x", "12", "end."]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(25)]
    passage = " ".join(words(rng, 60))
    out = [None, "", "  ", "a", "a b c", "a  b\tc", "A b c", "one two three four", "aaaa " * 90, "abcdefghij" * 60, *base]
    out += [base[3], base[3].replace(" ", "\n", 3), base[4] + " tail", passage, "x " + passage + " y", passage + "\n" + base[5]]
    near = base[6].split() + words(rng, 60)
    for i in range(8):
        out.append(" ".join(near[:i * 9] + [f"edit{i}"] + near[i * 9 + 1 :]))
    out += [" ".join(words(rng, 3000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["s1", "s0", None, "s2"]
    rows = [(i * 3 % 101, t, "en", sources[i % 4], None, "t", 1, 2) for i, t in enumerate(texts)]
    rows += [(rows[12][0], rows[12][1], *rows[12][2:]), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("block", [4, 8192])
def test_exact_groups(docs, empty, block):
    groups = defaultdict(list)
    for i, t in held(docs):
        groups[SPACE.sub(" ", t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            want[(i, least, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicated(docs).count() == len(groups)


def brute_bytes(rows, length):
    data = [t.encode() for _, t in rows]
    count = Counter(t[p : p + length] for t in data for p in range(len(t) - length + 1))
    for (i, _), t in zip(rows, data, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        yield i, len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "bucket"), [(200, 8192), (40, 2)])
def test_suffix_dedup(docs, empty, length, bucket):
    got = suffix_dedup.dedup_bytes(docs, length, bucket).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_bytes(held(docs), length))
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_suffix_sort_orders_and_survives_hash_collisions():
    rng = np.random.default_rng(1)
    for limit in (1, 5, 20, 33):
        buf = np.tile(rng.integers(97, 99, 40).astype(np.uint8), 6)
        at = rng.permutation(len(buf) - limit)[:120].astype(np.int64)
        group = rng.integers(0, 3, len(at))
        order, same = suffix_sort.sort_suffixes(buf, at, group, limit)
        want, wanted = suffix_sort._by_bytes(buf, at, group, limit)
        key = lambda i: (int(group[i]), bytes(buf[at[i] : at[i] + limit]))  # noqa: B023, E731
        assert [key(i) for i in order] == [key(i) for i in want] and same.tolist() == wanted.tolist()
    # The Thue-Morse word and its complement have one polynomial hash modulo 2^64.
    word = np.array([bin(i).count("1") & 1 for i in range(1 << 13)], np.uint8)
    order, same = suffix_sort.sort_suffixes(np.concatenate([word, 1 - word]), np.array([0, 1 << 13]), np.zeros(2, int), 4096)
    assert order.tolist() == [0, 1] and not same.any()


def test_window_dedup(docs, empty):
    rows = held(docs)
    first = {}
    every = [(i, WORD.findall(t)) for i, t in rows]
    rank = lambda i: (1 << 63) - 1 if i is None else i
    for i, w in every:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, rank(i)), rank(i))
    want = Counter()
    for i, w in every:
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < rank(i) for q in range(p, p + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.dedup_windows(docs).drop("kept").collect()) == want
    assert substring_dedup.dedup_windows(empty).count() == 0


def brute_components(rows, n, percent):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    names = defaultdict(list)
    for x in range(len(rows)):
        names[find(x)].append(rows[x][0])
    return Counter((rows[x][0], len(sets[x]), min((i for i in names[find(x)] if i is not None), default=None)) for x in range(len(rows))), len(names)


@pytest.mark.parametrize(("n", "percent", "group"), [(4, 85, 2048), (5, 80, 3)])
def test_jaccard(docs, empty, monkeypatch, n, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    want, components_ = brute_components(held(docs), n, percent)
    got = jaccard.jaccard_components(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == want
    assert jaccard.representatives(docs, n, percent).count() == components_
    assert jaccard.jaccard_components(empty, n, percent).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def test_mixing_shares_and_oracle(spark, docs, empty, tmp_path):
    got = mixing.mix_sources(docs).collect()
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(taken.values())


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, max_tokens=64).collect()
    want = defaultdict(list)
    for i, t in held(docs):
        want[i].append([*tokenizer.encode(t, add_special_tokens=False).ids, 2])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, ids in want.items():
        expected = Counter((s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes()), len(x)) for x in ids for s in range(0, len(x), 64))
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[i]) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in rows) >= 0.85 * 64 * len(sequences)
    assert packing.pack(empty).count() == 0


def test_pieces_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    rng, alphabet = random.Random(2), "aAbBzé É×÷ßÿÀÞ'sdmre12<|>.,!\t\n\x0b\x1c\x85 İıſΣ한字́e\x00_`~ª½²"
    texts = ["", "I'm don't 're", "<|endoftext|>a", "é a ́", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000))]
    ((_, _, buf, offsets),) = chunks(pa.array(texts), 1 << 30)
    ids, at = packing.WordIds.of(packing.tokenizer_path()).texts(buf, offsets, 2)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_patterns_hold_the_histogram():
    rng = random.Random(3)
    histogram = {rng.randint(1, 256): rng.randint(1, 50) for _ in range(120)}
    found = packing.patterns(histogram, 256)
    held_ = Counter()
    for count, pattern in found:
        assert sum(pattern) <= 256
        for x in pattern:
            held_[x] += count
    assert held_ == histogram


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype("float32")
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0, 2.0]), (None, rows[0][1])]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    hits = asked = 0
    for i, v in good:
        if i % 50:
            continue
        score = sorted(((-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j) for j, w in good if j != i), key=lambda s: (round(s[0], 12), s[1]))[:5]
        mine = sorted(got[i])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({m[1] for m in mine} & {j for _, j in score})
        asked += 5
    assert hits / asked >= 0.9 and set(got) == {i for i, _ in good if i % 50 == 0}
    assert [m[1] for m in sorted(got[50])] == [1000, 1001, 1002, 1003, 1004]


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in ann.nearest(df).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op6_quality(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held_out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held_out]) > 0.95
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    assert quality.good(docs, labels).columns == docs.columns


def test_quality_without_labels_and_texts(docs, empty, spark):
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(empty, none).count() == 0


def test_language_of_pages(spark):
    page = lambda lang, text: f'<html lang="{lang}"><script>var a="the";</script><p>{text}</p></html>'
    de, en = "der die und nicht ist das auf einen mit sich", "the and of that with this from have which not"
    documents = spark.createDataFrame([(i, (de if i % 2 else en) * 5, "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    rows = [(i, f"https://a{i % 3}.example.de/x", page("de", de)) for i in range(20)] + [(50, "http://b.example.com", page("de", en)), (51, None, None), (52, "::odd", ""), (53, "https://a1.example.de/", "<p>12</p>")]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), documents).collect()}
    assert len(got) == 24 and all(got[i]["lang"] == "de" for i in range(20))
    assert got[50]["text_lang"] == "en" and got[53]["lang"] == "de"
    assert all(0 < r["probability"] <= 1 for r in got.values())


def test_license_notices(spark):
    texts = ["x\nLicensed under CC BY-NC 4.0.\n", "my driver's license expired", None, "", "Released under the MIT License. " + "word " * 2000, "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): r for r in license_scan.scan(df).collect()}
    assert got[0, 2]["family"] == "CC-BY-NC" and got[0, 2]["confirmed"]
    assert got[1, 1]["family"] == license_scan.UNKNOWN
    assert got[5, 1]["family"] == "Apache-2.0" and got[6, 1]["family"] == "MIT" and got[4, 1]["family"] == "MIT"
    # The native scores are those of the model in numpy.
    vocabulary, w, b, temperature = license_scan.model()
    at = {g: i for i, g in enumerate(vocabulary)}
    logits = (b + w[[at[g] for g in license_scan.grams(texts[6]) if g in at]].sum(0)) / temperature
    assert got[6, 1]["probability"] == pytest.approx(float(license_scan._softmax(logits).max()), abs=1e-3)


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        theirs = con.execute(sql)
        columns = [d[0] for d in theirs.description]
        show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
        assert sorted(tuple(map(show, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(show, r)) for r in theirs.fetchall()), name


def test_grams():
    h = np.arange(1, 30, dtype=np.uint64)
    for k in (1, 2, 3, 5, 13):
        g = gram_hashes(h, k)
        assert len(g) == 30 - k and len(set(g.tolist())) == len(g)
        assert (gram_hashes(h[4:], k) == g[4:]).all()


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    table = {"quality": None}
    for name, stage in pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == names
        table[name] = docs.collect()
        if name == "exact_dedup":
            kept = [SPACE.sub(" ", r["text"] or "") for r in table[name]]
            assert len(set(kept)) == len(kept) <= before
        if name == "near_dedup":
            _, n = brute_components([(r["doc_id"], r["text"] or "") for r in table["exact_dedup"]], 5, 80)
            assert len(table[name]) == n
        if name != "packing":
            docs = spark.createDataFrame(table[name], docs.schema)
    assert sum(r["length"] for r in table["packing"]) > 0


def test_cosines_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e300, 0.0]), (2, [1e-200, 1e-200]), (3, [0.0, 2.0])]
    got = {(r["rank"], r["vec_id"]): r["score"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1, 2] == pytest.approx(1.0) and got[2, 1] == got[3, 3] == pytest.approx(0.5**0.5)


def test_other_vocabularies_go_through_the_whole_tokenizer():
    from pathlib import Path

    from tokenizers import Tokenizer

    assert not packing.WordIds.of(packing.tokenizer_path()).whole
    texts = ["", "It's 12 Übung", "  two  spaces\n", "plain words"]
    ((_, _, buf, offsets),) = chunks(pa.array(texts), 1 << 30)
    for file in Path(packing.tokenizer_path()).parent.glob("*.json"):
        try:
            tokenizer = Tokenizer.from_file(str(file))
        except Exception:  # noqa: BLE001  not every file there is one of this kind
            continue
        ids, at = packing.WordIds.of(str(file)).texts(buf, offsets, 7)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 7], file.name
