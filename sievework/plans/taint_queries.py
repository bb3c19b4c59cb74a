"""Taint in generated programs: a file an order, a statement and a sink a line item, in two functions whose names don't meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import taint


def _programs(spark, sf_dir):
    """Names v0 to v3; a statement's kind and the names it uses follow from the item's keys. Texts are made from these once they are together."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    name = lambda c: F.concat(F.lit("v"), (c % 4).cast("int").cast("string"))

    def line(x):
        kind, k, j, target = x["kind"], name(x["k"]), name(x["j"]), name(x["n"])
        value = (
            F.when(kind == 0, F.lit("req.query")).when(kind == 1, F.lit("'it''s' /* req.body */".replace("''", "\\'")))
            .when(kind == 2, F.concat(F.lit("DOMPurify.sanitize("), k, F.lit(" + req.body.x)"))).when(kind == 3, F.concat(F.lit("`a${"), k, F.lit("}b` + ("), j, F.lit(")")))
            .when(kind == 4, F.concat(k, F.lit("\n  + 'x'"))).otherwise(F.concat(F.lit("run(1, ["), k, F.lit("])")))
        )
        return F.concat(F.lit("  "), target, F.lit(" = "), value, F.when(x["k"] % 2 == 0, ";").otherwise(""), F.lit("\n  el.innerHTML = "), target, F.lit(";\n"))

    item = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 6).cast("tinyint").alias("kind"), (F.col("l_suppkey") % 4).cast("tinyint").alias("k"), (F.col("l_quantity").cast("long") % 4).cast("tinyint").alias("j"))
    body = lambda odd: F.array_join(F.transform(F.filter("items", lambda x: (x["n"] % 2 == 1) == odd), line), "")
    text = F.concat(F.lit("let v0, v1, v2, v3 = req.body;\nfunction f() {\n"), body(F.lit(True)), F.lit("}\nconst g = (a) => {\n"), body(F.lit(False)), F.lit("}\n"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items")).select(F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".js")).alias("path"), text.alias("text"))


def taint_sinks(spark, sf_dir):
    """Sinks a file that are reported, and how many of them are tainted."""
    return taint.scan(_programs(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("found"), F.count_if(F.col("rule") == "SAST/InnerHTMLAssignment [tainted]").alias("tainted"))


def taint_names(spark, sf_dir):
    """Safe and tainted names by function."""
    return taint.names(_programs(spark, sf_dir)).where("scope >= 0").groupBy("path").agg(F.count_if("safe").alias("safe"), F.count_if("tainted").alias("tainted"))


_FACTS = """WITH RECURSIVE s AS (
  SELECT l_orderkey AS o, l_linenumber % 2 AS f, l_linenumber % 4 AS n, l_partkey % 6 AS kind, l_suppkey % 4 AS k, CAST(floor(l_quantity) AS BIGINT) % 4 AS j FROM lineitem
),
given AS (SELECT o, f, list({'n': n, 'kind': kind, 'k': k, 'j': j}) AS given FROM s GROUP BY o, f),
safe AS (
  SELECT o, f, given, list_sort(list_distinct([x.n FOR x IN given IF x.kind IN (1, 2)])) AS s, CAST(NULL AS BIGINT[]) AS before FROM given
  UNION ALL
  SELECT o, f, given, list_sort(list_distinct(list_concat(s, [x.n FOR x IN given IF (x.kind = 4 AND list_contains(s, x.k)) OR (x.kind = 3 AND list_contains(s, x.k) AND list_contains(s, x.j))]))), s FROM safe WHERE s IS DISTINCT FROM before
),
tainted AS (
  SELECT o, f, given, s, list_sort(list_distinct([x.n FOR x IN given IF x.kind = 0])) AS t, CAST(NULL AS BIGINT[]) AS before FROM safe WHERE s IS NOT DISTINCT FROM before
  UNION ALL
  SELECT o, f, given, s, list_sort(list_distinct(list_concat(t, [x.n FOR x IN given IF NOT list_contains(s, x.n) AND ((x.kind IN (3, 4, 5) AND list_contains(t, x.k)) OR (x.kind = 3 AND list_contains(t, x.j)))]))), s_t FROM (SELECT *, t AS s_t FROM tainted) WHERE t IS DISTINCT FROM before
),
facts AS (SELECT o, f, s, t FROM tainted WHERE t IS NOT DISTINCT FROM before)
"""
QUERIES = {f.__name__: f for f in (taint_sinks, taint_names)}
ORACLES = {
    "taint_sinks": _FACTS
    + """SELECT 'src/o' || o || '.js' AS path, count(*) AS found, count(*) FILTER (WHERE list_contains(t, n)) AS tainted
FROM s JOIN facts USING (o, f) WHERE NOT list_contains(s.s, n) GROUP BY o""".replace("s.s", "facts.s"),
    "taint_names": _FACTS
    + """SELECT 'src/o' || o || '.js' AS path, CAST(sum(len(s)) AS BIGINT) AS safe, CAST(sum(len(t)) AS BIGINT) AS tainted FROM facts WHERE len(s) + len(t) > 0 GROUP BY o""",
}
