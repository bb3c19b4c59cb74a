"""The longest encoded run is sought in the whole page."""

from sievework.plans.catalogue import QUERIES


def test_blob_after_the_first_400_characters(spark, tmp_path):
    rows = [(1, "x" * 900 + " " + "a1" * 300), (2, "x" * 900), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["longest"] for r in QUERIES["blob_longest"](spark, str(tmp_path)).collect()}
    assert got == {1: 1500, 2: None, 3: None}
