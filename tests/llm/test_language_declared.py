"""The declared language is found anywhere in a page."""

import re
import time

import pytest

from sievework.llm import language_id

OLD = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)


@pytest.mark.parametrize(
    "page",
    [None, "", "<html>", "<html lang=de>", "<HTML\n class=x XML:LANG = 'En-gb'>", "<html lang=deutsch><html lang=fr>", "<htmlx lang=de>", "<html a=b><p lang=en>", "<html lang=en", "<html <html lang=it>", "<html lang='es", "<html lang=>x lang=de"],
)
def test_declaration_of_short_pages(page):
    m = OLD.search(page or "")
    assert language_id.declaration_of(page) == (m[1].lower() if m else None)


def test_declaration_after_a_long_preamble(spark):
    documents = spark.createDataFrame([(i, "the and of" if i % 2 else "der die und", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    page = "<!--" + "x" * 70000 + "--><html lang='de'><p>der die und</p></html>"
    pages = spark.createDataFrame([(1, "http://a.example/", page), (2, "http://a.example/", "<p>the</p>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["declared"] for r in language_id.identify(pages, documents).collect()} == {1: "de", 2: "none"}


def test_declaration_is_found_in_linear_time():
    began = time.time()
    assert language_id.declaration_of("<html " * 200000) is None
    assert language_id.declaration_of("<html>" * 200000 + " lang" * 200000) is None
    assert time.time() - began < 5
