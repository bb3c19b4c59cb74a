"""The text scan's observable rules."""

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import report as R
from sievework.operators import scan as S

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def scanned(spark, *texts, **kw):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    return sorted((r["path"], r["line"], r["rule"], r["severity"], r["suppressed"]) for r in S.scan(df, **kw).collect())


def test_clean_and_empty(spark):
    assert scanned(spark, "nothing here", "", None) == []


def test_key_found_with_line_and_severity(spark):
    assert scanned(spark, f"a\r\nb {KEY}\n") == [("f0", 2, "AWS Access Key", "critical", None)]


def test_placeholder_silences_the_pattern_for_its_line(spark):
    assert scanned(spark, f"x {'AKIA' + 'IOSFODNN7EXAMPLE'} {KEY}", entropy=False) == []


def test_standalone_marker_covers_the_next_line_only(spark):
    text = f'# {T.MARKER} reason="fixture"\n{KEY}\n{KEY}'
    assert [(r[1], r[4]) for r in scanned(spark, text)] == [(2, "fixture"), (3, None)]


def test_own_reason_wins(spark):
    text = f"// {T.MARKER} above\n{KEY} // {T.MARKER} — own */"
    assert [(r[1], r[4]) for r in scanned(spark, text)] == [(2, "own")]


def test_entropy_and_its_noise(spark):
    token = "Zx9Qw7Er5Ty3Ui1Op0As8Df6Gh4Jk2Lz"
    digest = "0123456789abcdef0123456789abcdef01234567"
    assert [r[2] for r in scanned(spark, f"k = {token}")] == ["High Entropy String (base64)"]
    assert scanned(spark, f"k = {digest}", f"sha512-{token}", f"url(data:x;base64,{token})") == []


def test_key_block_stops_entropy(spark):
    token = "Zx9Qw7Er5Ty3Ui1Op0As8Df6Gh4Jk2Lz"
    text = f"-----BEGIN PUBLIC KEY-----\n{token}\n-----END PUBLIC KEY-----\n{token}"
    assert [r[1] for r in scanned(spark, text)] == [4]


def test_every_pattern_compiles_and_has_a_severity(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in T.PATTERNS], "rule string").withColumn("s", S.severity(F.col("rule")))
    assert {r["rule"]: r["s"] for r in df.collect()} == {n: s for n, _, s in T.PATTERNS}


def test_status_and_exit(spark):
    none = spark.createDataFrame([], "rule string")
    checks = spark.createDataFrame([("a", "passed"), ("b", "incomplete")], "id string, status string")
    assert R.status(none, checks).first()["status"] == "incomplete"
    assert R.status(none, checks.where("id = 'a'")).first()["status"] == "passed"
    assert R.status(none.sparkSession.createDataFrame([("x",)], "rule string"), checks).first()["status"] == "findings"


def test_sarif_is_json_and_tells_of_unfinished_checks(spark):
    import json

    found = spark.createDataFrame([("./a", 0, "R", "high")], "path string, line int, rule string, severity string")
    checks = spark.createDataFrame([("c", "error")], "id string, status string")
    doc = json.loads(R.sarif(found, checks).first()["sarif"])
    assert doc["runs"][0]["invocations"][0]["executionSuccessful"] is False
    assert "region" not in doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"]


def test_silent_step_is_a_passed_check(spark):
    f, c = spark.createDataFrame([], "path string"), spark.createDataFrame([], "id string, status string")
    _, checks = R.merge_steps({"a": (f, c), "b": (f, spark.createDataFrame([("x", "error")], "id string, status string"))})
    assert sorted(map(tuple, checks.select("id", "status").collect())) == [("a", "passed"), ("b/x", "error")]


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(f"a {KEY} b",)], "content string").select(S.redacted(F.col("content"), T.PATTERNS[0][1]).alias("x"))
    assert df.first()["x"] == "a [REDACTED] b"
