"""License scan: a trained paragraph classifier, with DataFrame operations only.

A paragraph is a line of text, or a run of lines up to a blank one, under its first line's number. It is the set of its word unigrams and bigrams. A multinomial logistic regression over a sparse
vocabulary of them, fitted here on licence notices and on sentences that only sound like them, gives each licence family
and ``unknown`` a probability. A temperature, fitted on templates that the weights didn't see, calibrates them. A family counts only if it is
likelier than ``LEAST``, and is confirmed if the paragraph also has enough bigrams in common with one of the family's templates.

A run of lines counts as one notice if none of its lines is one, if lines are named otherwise and less likely, or if it has twice the odds of any line; else its lines count.

A paragraph is left out only if it is unknown for certain: where none of the words occurs that n-grams which speak for some family hold (``telling``), or, without an
anchor, where the most that its n-grams can add to a family is too little. One pattern finds the words, so most texts cost one pass.

Scale: paragraphs are reduced to the n-grams that the model or a template knows, which
meet the weights, a table of a fixed size that is broadcast, and are summed by paragraph, by a key that
spreads even if all documents hold the same notice. Texts are never shuffled.

Defined cases: null and empty texts have no findings; a paragraph of any length is scored whole; rows with one doc_id are
told apart by a hash of their text, and rows alike in both share one set of findings; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by family; {} stands for a place where wordings vary.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "Released under Apache 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License; see the LICENSE file.",
        "Licensed under MIT.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under GPL v3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Distributed under GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "You can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under LGPL 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Distributed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.",
        "Released under CC0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "proprietary": (
        "Copyright by the author. All rights reserved.",
        "This document is confidential and proprietary; all rights reserved, no license is granted.",
    ),
    UNKNOWN: (
        "You need a valid driver's license to rent a car.",
        "The fishing license can be renewed at the town hall.",
        "Please ask for permission before you enter the building.",
        "The committee gave its permission to publish the report.",
        "He licensed his patent to a competitor last year.",
        "Our terms of service have changed since version 2 of the app.",
        "The general public was invited to the free concert.",
        "An Apache helicopter landed at the base on Monday.",
        "She studies physics at MIT and works in a laboratory.",
        "The warranty covers parts for three years.",
        "The copyright office is closed on public holidays.",
        "A license plate was found near the river.",
        "The new version 3 of the product is released under heavy rain.",
        "This work was licensed for the stage and not for film.",
        "Mozilla announced a new browser and a public beta.",
        "The creative commons room is open to all students.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "You should have received a copy of the license along with this program.",
        "The film was released under a new title and distributed under the name of his son.",
        "Redistribution of land was the aim of the law.",
        "Er kommt mit dem Zug und mit seinen Kindern.",
        "Das Haus mit dem Garten liegt am Ende der Stadt.",
        "Sie spricht mit der Lehrerin.",
        "Wir fahren mit.",
        "Kaffee mit Milch und Tee mit Zucker.",
        "Ein Tag mit viel Regen ist es heute.",
    ),
}
FAMILIES = tuple(TEMPLATES)
ANCHORS = r"(?i)licen[cs]e|copyright|permission|redistribut|warranty|public domain|spdx|all rights reserved|waived|\bgnu\b|\bcc[ -]?(?:by|0)"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Function words say nothing about a licence: an n-gram of them alone is no feature.
FUNCTION_WORDS = frozenset(
    "a about all an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its made make many may more most my no not of off on one "
    "only or other our out over shall she should since so some such than that the their them then there these they this those to under up upon us was we were what when where which who will with would you your".split()
)
#: Least probability of a family, and least share of a paragraph's or a template's bigrams in common.
LEAST, CONFIRMED = 0.6, 0.5
KEYS = ("doc_id", "tag", "block", "line", "whole")


def grams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def _wordings(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The text and variants of it: words left out, words around it, another order of its parts."""
    around = "the code in this file and all of its parts is made by many people who work on it since long for everyone with care".split()
    out = [text]
    words = text.split()
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.12] or words
        front, back = (list(rng.choice(around, rng.integers(0, 5))) for _ in range(2))
        out.append(" ".join([*front, *kept, *back]))
    return out


@cache
def model() -> tuple[tuple[str, ...], np.ndarray, np.ndarray, float]:
    """Vocabulary, weights, biases and temperature, from a fixed seed."""
    rng = np.random.default_rng(5)
    rows = [(grams(t), i, k) for i, f in enumerate(FAMILIES) for k, w in enumerate(TEMPLATES[f]) for t in _wordings(w, rng, 12)]
    counts: dict[str, int] = {}
    for g, _, _ in rows:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    vocabulary = tuple(sorted(x for x, n in counts.items() if n >= 4 and not FUNCTION_WORDS.issuperset(x.split())))
    at = {x: i for i, x in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (g, _, _) in enumerate(rows):
        x[r, [at[t] for t in g if t in at]] = 1
    target, template = (np.array([r[i] for r in rows]) for i in (1, 2))
    # The temperature is that of templates which the weights haven't seen, a third of each family's at a time.
    logits = np.zeros((len(rows), len(FAMILIES)))
    for fold in range(3):
        aside = template % 3 == fold
        w, b = _fitted(x[~aside], target[~aside])
        logits[aside] = x[aside] @ w + b
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.3, 5, 57), key=loss).round(4))
    return vocabulary, *_fitted(x, target), temperature


def _fitted(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights, small ones left out, and biases of a softmax regression in which all families weigh alike."""
    y = np.eye(len(FAMILIES))[target]
    weight = (1 / np.maximum(y.mean(0), 1e-9))[target]
    w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
    for _ in range(250):
        e = (_softmax(x @ w + b) - y) * weight[:, None] / weight.sum()
        w = (w - 4.0 * (x.T @ e)) * (1 - 4.0 * 2e-5)
        b -= 1.0 * e.sum(0)
    # A paragraph with nothing of the vocabulary is unknown.
    b[FAMILIES.index(UNKNOWN)] += 1.0
    return np.where(np.abs(w) < 0.01, 0.0, w).round(6), b.round(6)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _trie(words: list[str]) -> str:
    """A pattern for any of the words that branches by letter."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[:1], []).append(w[1:])
    arms = [re.escape(c) + _trie(rest) for c, rest in sorted(first.items()) if c]
    inner = arms[0] if len(arms) == 1 and "" not in first else f"(?:{'|'.join(arms)})" if arms else ""
    return f"(?:{inner})?" if "" in first and inner else inner


@cache
def telling() -> str:
    """A pattern that every text holds, in lower case, that has an n-gram which speaks for a family: without one, the least that unknown leads by stands.

    It names of each such n-gram the words that are no function words; some word of each n-gram is none."""
    vocabulary, w, _, _ = model()
    most = (w[:, :-1] - w[:, [-1]]).max(1)
    words = {max((x for x in g.split() if x not in FUNCTION_WORDS), key=lambda x: (len(x), x)) for g, m in zip(vocabulary, most, strict=True) if m > 0}
    return f"(?<![a-z0-9]){_trie(sorted(words))}(?![a-z0-9])"


@cache
def bounds() -> tuple[list[tuple[float, list[str]]], float]:
    """Steps of n-grams by the most that one adds to any family over unknown, and the sum below which a paragraph is unknown for certain."""
    vocabulary, w, b, temperature = model()
    most = (w[:, :-1] - w[:, [-1]]).max(1)
    steps, low = [], 0.0
    for high in (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, float(most.max())):
        steps.append((high, [g for g, m in zip(vocabulary, most, strict=True) if low < m <= high]))
        low = max(low, high)
    # A family of probability p leads unknown by the logarithm of p / (1 - p) at least; from 0 on, as the best one does.
    return [x for x in steps if x[1]], float((b[-1] - b[:-1]).min())


def units(docs: DataFrame) -> DataFrame:
    """doc_id, tag, block, line, whole and p: each line that isn't blank, and each run of several such lines as a whole, under its first line's number, of those with a telling word."""
    number = lambda line, i: F.when(line.rlike(r"\S"), F.concat((i + 1).cast("string"), F.lit("\x01"), line)).otherwise("")
    numbered = F.btrim(F.array_join(F.transform(F.split("text", "\n", -1), number), "\n"), F.lit("\n"))
    tells = lambda x: F.lower(x).rlike(telling())
    blocks = docs.where(tells("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), F.explode(F.split(numbered, "\n{2,}")).alias("b")).where(tells("b"))
    first = lambda x: F.substring_index(x, "\x01", 1).cast("int")
    unit = lambda x, whole: F.struct(first(x).alias("line"), F.lit(whole).alias("whole"), F.regexp_replace(x, "(?:^|\n)[0-9]+\x01", " ").alias("p"))
    lines = F.transform(F.split("b", "\n"), lambda x: unit(x, False))
    several = F.when(F.contains("b", F.lit("\n")), F.concat(lines, F.array(unit(F.col("b"), True)))).otherwise(lines)
    return blocks.select("doc_id", "tag", first(F.col("b")).alias("block"), F.inline(several)).where(tells("p"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, tag, block, line, whole, n_bigrams and the known grams of the paragraphs with an anchor and of all others that may be a notice."""
    vocabulary = model()[0]
    known = sorted({*vocabulary, *(g for f in FAMILIES[:-1] for t in TEMPLATES[f] for g in grams(t))})
    words = F.regexp_extract_all(F.lower("p"), F.lit(f"({WORD})"))
    rows = units(docs).select("doc_id", "tag", "block", "line", "whole", words.alias("w"), F.col("p").rlike(ANCHORS).alias("anchor")).where(F.size("w") > 0)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("pairs", pairs).withColumn("grams", F.array_distinct(F.filter(F.concat("w", "pairs"), lambda g: g.isin(known))))
    steps, least = bounds()

    def most(g):
        out = F.lit(0.0)
        for high, of in steps:
            out = F.when(g.isin(of), high).otherwise(out)
        return out

    may = F.aggregate("grams", F.lit(0.0), lambda a, g: a + most(g)) >= least
    return rows.where(F.col("anchor") | may).select("doc_id", "tag", "block", "line", "whole", F.size(F.array_distinct("pairs")).alias("n_bigrams"), "grams")


def scan(docs: DataFrame, least: float = LEAST, confirmed: float = CONFIRMED) -> DataFrame:
    """doc_id, tag, line, family, probability, similarity and confirmed of every paragraph with an anchor, and of the others that may be a notice; family is unknown where none is likely enough."""
    spark = docs.sparkSession
    vocabulary, w, b, temperature = model()
    # As many rows as the vocabulary has n-grams, fixed by the templates.
    table = json.dumps([{"gram": g, "weights": row.tolist()} for g, row in zip(vocabulary, w, strict=True)])
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<gram:string,weights:array<double>>>")))
    lines = paragraphs(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    exploded = lines.select(*KEYS, "n_bigrams", F.col("grams").alias("known"), F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    each = [F.sum(F.coalesce(F.element_at("weights", i + 1), F.lit(0.0))).alias(f"s{i}") for i in range(len(FAMILIES))]
    summed = exploded.groupBy(*KEYS).agg(F.first("n_bigrams").alias("n_bigrams"), F.first("known").alias("known"), *each)
    logits = F.array(*((F.col(f"s{i}") + F.lit(float(v))) / temperature for i, v in enumerate(b)))
    scored = summed.select(*KEYS, "n_bigrams", "known", logits.alias("logits")).withColumn("top", F.array_max("logits"))
    mass = F.aggregate(F.transform("logits", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("logits", F.col("top")).cast("int"))
    scored = scored.select(*KEYS, "n_bigrams", "known", best.alias("best"), (1 / mass).alias("probability"))
    common = F.lit(0.0)
    for family in FAMILIES[:-1]:
        tries = []
        for template in TEMPLATES[family]:
            own = [g for g in grams(template) if " " in g] or grams(template)
            both = F.size(F.array_intersect("known", F.array(*map(F.lit, own))))
            tries.append(both / F.least(F.greatest("n_bigrams", F.lit(1)), F.lit(len(own))))
        common = F.when(F.col("best") == family, F.greatest(*tries) if len(tries) > 1 else tries[0]).otherwise(common)
    named = F.when(F.col("probability") >= least, F.col("best")).otherwise(UNKNOWN)
    judged = scored.select(*KEYS, named.alias("family"), F.round("probability", 4).alias("probability"), F.round(common, 4).alias("similarity"))
    # Several lines are one notice if none of them is one, if they contradict it and are less likely, or if it has twice the odds of any.
    block = Window.partitionBy("doc_id", "tag", "block")
    judged = judged.withColumn("joint", F.max(F.when(F.col("whole"), F.col("family"))).over(block)).withColumn("joint_p", F.max(F.when(F.col("whole"), F.col("probability"))).over(block))
    line = ~F.col("whole") & (F.col("family") != UNKNOWN)
    likeliest, other = F.max(F.when(line, F.col("probability"))).over(block), F.max(line & (F.col("family") != F.col("joint"))).over(block)
    far = F.col("joint_p") * (1 - likeliest) >= 2 * likeliest * (1 - F.col("joint_p"))
    stands = F.coalesce((F.col("joint") != UNKNOWN) & (likeliest.isNull() | F.when(other, F.col("joint_p") > likeliest).otherwise(far)), F.lit(False))
    kept = judged.withColumn("stands", stands).where(F.col("whole") == F.col("stands"))
    return kept.select("doc_id", "tag", "line", "family", "probability", "similarity").withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= confirmed))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence notices in all of ``documents``: family, probability and confirmation by paragraph."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.where(F.col("family") != UNKNOWN).select("doc_id", "line", "family", "probability", "similarity", "confirmed")
