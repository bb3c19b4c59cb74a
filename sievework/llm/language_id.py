"""Language ID of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page's language are added as logarithms: the likelihood of its visible text under byte-trigram
models, how often pages of a language declare the markup language that this one declares, how often they live under its
address suffix, and the prior of its host. The models are fitted on labelled documents; the three tables
are estimated over all pages from what the text alone says of each page, by grouped aggregation. Priors are smoothed down a hierarchy:
a host leans on its registered domain, that on all pages, by pseudo-counts. A page doesn't speak for itself: what it
added to its host and domain is taken out again.

Scale: pages are read once and reduced to a few numbers each; html is never shuffled. Hosts and suffixes are joined as
plain tables, which adaptive execution splits at a host that holds a third of all pages. The models, and the
table of declarations, are bounded by the number of languages: every label of a document is one, 256 KB of model each.

Defined cases: null or empty html has no text evidence, and a page without evidence of any kind gets the overall prior; a
missing, unknown or odd declaration is a value of its own; null or odd addresses have host, domain and suffix ''; rows
with one page_id are pages of their own; without labelled documents the result has no rows, as there are no languages; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lowered, materialize, mix, ship, tidy

#: Labelled documents that the text models are fitted on, in equal shares by the smallest hashes of their ids, and the least share of a language.
FIT_ROWS, LEAST_ROWS = 4000, 50
CELLS = 1 << 15
#: Trigrams count as so many independent ones at most: neighbours overlap, and pages quote other languages.
EVIDENCE = 40.0
#: Pseudo-counts: a host leans on its domain, a domain on all pages, tables on an even spread.
HOST_LEAN, DOMAIN_LEAN, TABLE_LEAN = 5.0, 20.0, 1.0

HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav|template|noscript)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
HTML = re.compile(r"<html\b", re.I)
DECLARED = re.compile(r"\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)


def visible(page: str | None) -> str:
    """A page's text without markup, scripts, styles and navigation."""
    return html.unescape(HIDDEN.sub(" ", page or ""))


def declaration_of(page: str | None) -> str | None:
    """The language that the first html tag with one declares, wherever it stands; each character is looked at once."""
    page, at = page or "", 0
    while m := HTML.search(page, at):
        end = page.find(">", m.end())
        # A tag that is never closed goes on to the end, and takes in all later ones.
        at = end if end >= 0 else len(page)
        if found := DECLARED.search(page, m.end(), at):
            return found[1].lower()
    return None


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the byte trigrams within each row, letters in lower case and everything that is no letter as a space."""
    low = lowered(buf)
    low[(low < 97) | ((low > 122) & (low < 128))] = 32
    x = low.astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    row = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
    inside = (np.arange(len(code)) + 3 <= offsets[row + 1]) & ~((low[:-2] == 32) & (low[1:-1] == 32))
    return row[inside], (mix(code[inside]) % np.uint64(CELLS)).astype(np.int64)


def fit(documents: DataFrame, limit: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Every language that a document is labelled with and each one's log probabilities of the cells, from about ``limit`` documents dealt evenly."""
    known = documents.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not names:
        return [], np.zeros((0, CELLS))
    share = max(LEAST_ROWS, limit // len(names))
    # Small hashes, about twice a language's share of them and its least one always, are ordered; texts are not.
    low = (F.col("h") / 2.0**64 + 0.5) * F.col("n") < 2.0 * share
    few = ids.join(F.broadcast(sizes), "lang").where(low | (F.col("h") == F.col("least"))).select("lang", "doc_id", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= share).select("lang", "doc_id")
    labelled = known.join(F.broadcast(chosen), ["lang", "doc_id"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, b, buf, offsets in chunks(batch.column(1)):
                row, cell = trigrams(buf, offsets)
                for lang in set(langs[a:b]):
                    tables.setdefault(lang, np.zeros(CELLS))
                    tables[lang] += np.bincount(cell[langs[a:b][row] == lang], minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.string()), pa.array([t.astype("<f4").tobytes() for t in tables.values()], pa.binary())], names=["lang", "counts"])

    # The chosen few are scattered over the scan's tasks, so the tables are merged before they come to the driver.
    parts = labelled.select("lang", "text").repartition(4).mapInArrow(tidy(count), "lang string, counts binary")
    sums: dict[str, np.ndarray] = {}
    for r in parts.collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), "<f4").astype(float)
    table = np.array([sums[k] for k in names]).reshape(len(names), CELLS) + 0.5
    return names, np.log(table / table.sum(1, keepdims=True))


def evidence(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, the text's log likelihoods and what it alone says, for every page."""
    known = set(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_, urls = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            declared = []
            for p in pages_:
                m = declaration_of(p)
                declared.append((m if m in known else "other") if m else "none")
            hosts = [(m[1].lower().strip(".") if (m := HOST.match(u or "")) else "") for u in urls]
            labels = [h.split(".") for h in hosts]
            like = np.zeros((len(pages_), len(names)))
            for a, b, buf, offsets in chunks(pa.array([visible(p) for p in pages_], pa.large_string())):
                row, cell = trigrams(buf, offsets)
                n = np.bincount(row, minlength=b - a)
                for i, t in enumerate(model):
                    like[a:b, i] = np.bincount(row, t[cell], b - a) * np.minimum(1, EVIDENCE / np.maximum(n, 1))
            like -= like.max(1, keepdims=True, initial=-np.inf)
            says = np.exp(like) / np.exp(like).sum(1, keepdims=True)
            doubles = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, pa.string()), pa.array([".".join(x[-2:]) for x in labels], pa.string()), pa.array([x[-1] for x in labels], pa.string()), pa.array(declared, pa.string()), doubles(like), doubles(says)],
                names=["page_id", "host", "domain", "suffix", "declared", "likelihood", "says"],
            )

    schema = "page_id bigint, host string, domain string, suffix string, declared string, likelihood array<double>, says array<double>"
    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(tidy(scan), schema)


def identify(pages: DataFrame, documents: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """page_id, lang, probability, text_lang, declared and host of every page."""
    spark = pages.sparkSession
    ship(spark)
    names, model = fit(documents, limit)
    if not names:
        return spark.createDataFrame([], "page_id bigint, lang string, probability double, text_lang string, declared string, host string")
    every = range(len(names))
    rows = materialize(evidence(pages, names, model), "evidence")
    sums = lambda column: F.array(*(F.sum(F.element_at(column, i + 1)) for i in every))
    # Sums go up the hierarchy: hosts, domains, all pages.
    hosts = materialize(rows.groupBy("host", "domain").agg(sums("says").alias("host_sum")), "hosts")
    domains = materialize(hosts.groupBy("domain").agg(sums("host_sum").alias("domain_sum")), "domains")
    whole = domains.agg(sums("domain_sum").alias("x")).first()["x"]
    total = sum(x or 0.0 for x in whole)
    overall = [((x or 0.0) + 1) / (total + len(names)) for x in whole]

    # P(value | language), with pseudo-counts; declarations are as many as languages and two more.
    declared = rows.groupBy("declared").agg(sums("says").alias("n")).collect()
    column = [sum(r["n"][i] for r in declared) for i in every]
    spread = len(names) + 2
    table = {r["declared"]: [(r["n"][i] + TABLE_LEAN) / (column[i] + TABLE_LEAN * spread) for i in every] for r in declared}
    declaration = F.lit(None).cast("array<double>")
    for k, v in sorted(table.items()):
        declaration = F.when(F.col("declared") == k, F.array(*map(F.lit, v))).otherwise(declaration)
    suffixes = materialize(rows.groupBy("suffix").agg(sums("says").alias("suffix_sum")), "suffixes")
    kinds = max(1, suffixes.count())

    joined = rows.join(hosts.drop("domain"), "host").join(domains, "domain").join(suffixes, "suffix")
    own = F.col("says")
    item = lambda column, i: F.element_at(column, i + 1)
    others = lambda column, i: F.greatest(F.lit(0.0), item(column, i) - item(own, i))
    count = lambda column: sum((others(column, i) for i in every), F.lit(0.0))
    joined = joined.withColumns({"host_n": count("host_sum"), "domain_n": count("domain_sum")})
    domain = [(others("domain_sum", i) + DOMAIN_LEAN * overall[i]) / (F.col("domain_n") + DOMAIN_LEAN) for i in every]
    host = [(others("host_sum", i) + HOST_LEAN * domain[i]) / (F.col("host_n") + HOST_LEAN) for i in every]
    suffix = [(others("suffix_sum", i) + TABLE_LEAN) / (column[i] + TABLE_LEAN * kinds) for i in every]
    parts = joined.withColumn("declaration", declaration)
    logs = F.array(*(item("likelihood", i) + F.log(item("declaration", i)) + F.log(suffix[i]) + F.log(host[i]) for i in every))
    parts = parts.select("page_id", "declared", "host", "says", logs.alias("logs")).withColumn("top", F.array_max("logs"))
    parts = parts.withColumn("mass", F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    named = F.array(*map(F.lit, names))
    return parts.select(
        "page_id",
        F.element_at(named, F.array_position("logs", F.col("top")).cast("int")).alias("lang"),
        (1 / F.col("mass")).alias("probability"),
        F.element_at(named, F.array_position("says", F.array_max("says")).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` with its language."""
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
