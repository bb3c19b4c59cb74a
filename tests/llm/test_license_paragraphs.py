"""Notices are found without anchors and across line breaks."""

from sievework.llm import license_scan

GPL = "/*\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version.\n */"


def test_notices_without_anchor_and_wrapped_notices(spark):
    texts = [
        "Released under Apache 2.0.", "x\n\nCreative Commons Attribution 4.0", "int a;\n\n\n" + GPL.format(2) + "\n \nint b;", "\n" + GPL.format(3), "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only",
        "Das ist mit einem Wort mit allen.\n\nmit", "the of and\nReleased under the MIT License.\nand to the", "7\x01Released under Apache 2.0.\r\n\r\nx",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["line"], r["family"]) for r in license_scan.scan(df).collect() if r["family"] != license_scan.UNKNOWN}
    assert got == {(0, 1, "Apache-2.0"), (1, 3, "CC-BY"), (2, 4, "GPL-2.0"), (3, 2, "GPL-3.0"), (4, 1, "MIT"), (4, 2, "GPL-2.0"), (6, 2, "MIT"), (7, 1, "Apache-2.0")}


def test_nothing_dropped_is_a_notice(spark):
    """Every line that numpy's scores name is found."""
    import numpy as np

    vocabulary, w, b, temperature = license_scan.model()
    at = {g: i for i, g in enumerate(vocabulary)}
    rng = np.random.default_rng(3)
    lines = [" ".join(rng.choice([g for g in vocabulary], rng.integers(1, 5))) for _ in range(600)]
    got = {r["doc_id"]: r["family"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    for i, t in enumerate(lines):
        p = license_scan._softmax((b + w[[at[g] for g in license_scan.grams(t) if g in at]].sum(0)) / temperature)
        if p.max() > license_scan.LEAST + 1e-6 and p.argmax() < len(license_scan.FAMILIES) - 1:
            assert got[i] == license_scan.FAMILIES[p.argmax()], t
