"""Every labelled language is a candidate, however many there are and however rare it is."""

from sievework.llm import language_id


def test_every_language_is_fitted(spark):
    rows = [(i, f"word{i % 70} text", f"l{i % 70:02}") for i in range(140)]
    names, model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == [f"l{i:02}" for i in range(70)] and model.shape == (70, language_id.CELLS)


def test_a_rare_language_is_drawn(spark):
    rows = [(i, "the and of that", "en") for i in range(6000)] + [(7000, "ja nein zum", "de"), (7000, None, "fr"), (None, "x", "it")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, model = language_id.fit(documents, 4)
    assert names == ["de", "en"] and not (model[0] == model[0][0]).all()
    pages = spark.createDataFrame([(1, "http://a.example/", "<html lang=de><p>ja nein zum ja nein zum</p>")], "page_id long, url string, html string")
    assert [(r["lang"], r["declared"]) for r in language_id.identify(pages, documents, 4).collect()] == [("de", "de")]
    assert language_id.fit(documents.where("false"))[0] == []
