"""Training data for rerankers on parts: eligibility, pairs with hard negatives, splits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import training as L

from .dialect import sql_query
from .registry import query

ELIGIBLE = """el AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size = 1 THEN 'REVIEW' WHEN p_type LIKE 'S%' AND p_size > 45 THEN 'UNSAFE_FLAGS' WHEN p_name LIKE '%widget' THEN 'NON_PRODUCT'
 WHEN p_brand IS NULL THEN 'NO_SUBJECT' WHEN p_retailprice < 901 THEN 'LOW_CONFIDENCE' ELSE 'SAFE' END AS eligibility FROM part)"""
sql_query("training_eligibility", f"WITH {ELIGIBLE} SELECT p_partkey, eligibility FROM el", "D22")

NEG_SQL = f"""WITH {ELIGIBLE}, s AS (SELECT *, regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+') AS toks FROM el WHERE eligibility = 'SAFE'),
c AS (SELECT q.p_partkey AS query_id, d.p_partkey AS doc_id, CASE WHEN string_split(q.p_name, ' ')[2] = string_split(d.p_name, ' ')[2] THEN 'same_product' WHEN q.p_type = d.p_type THEN 'close_variant' ELSE 'trap' END AS category,
 len(list_intersect(q.toks, d.toks)) AS shared, len(list_distinct(list_concat(q.toks, d.toks))) AS total FROM (SELECT * FROM s WHERE p_partkey % 20 = 0) q JOIN s d ON q.p_partkey <> d.p_partkey),
g AS (SELECT query_id, doc_id, category, round(shared / total::DOUBLE + CASE category WHEN 'same_product' THEN 0.30::DOUBLE WHEN 'close_variant' THEN 0.18::DOUBLE ELSE 0.05::DOUBLE END, 6) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, doc_id) AS within FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN within <= CASE category WHEN 'same_product' THEN 2 ELSE 1 END THEN 0 ELSE 1 END, score DESC, doc_id) AS place FROM r)"""


def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.when(F.col("p_size") == 1, "REVIEW").when(F.col("p_type").like("S%") & (F.col("p_size") > 45), "UNSAFE_FLAGS").when(F.col("p_name").like("%widget"), "NON_PRODUCT").when(F.col("p_brand").isNull(), "NO_SUBJECT").when(F.col("p_retailprice") < 901, "LOW_CONFIDENCE").otherwise("SAFE")
    safe = part.withColumn("eligibility", kind).where("eligibility = 'SAFE'")
    toks = T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    d = safe.select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ")[1].alias("product"), F.lit(None).cast("string").alias("family"), F.array("p_type").alias("kind"), toks.alias("toks"))
    found = L.hard_negatives(d.where("doc_id % 20 = 0").withColumn("query_id", F.col("doc_id")), d, ["kind"])
    return found.withColumn("place", F.col("place").cast("long"))


@query("hard_negatives", f"{NEG_SQL} SELECT query_id, doc_id, category, score, place FROM f WHERE place <= 4")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two, one and one of the categories, filled up by score; every other part is a candidate."""
    return _negatives(spark, sf_dir)


@query("training_pairs", f"{NEG_SQL} SELECT query_id, query_id AS doc_id, 1 AS label, 'positive' AS pair_type FROM (SELECT DISTINCT query_id FROM f) UNION ALL SELECT query_id, doc_id, 0, 'hard_negative' FROM f WHERE place <= 4")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z19."""
    n = _negatives(spark, sf_dir)
    positive = n.select("query_id").distinct().select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("label"), F.lit("positive").alias("pair_type"))
    return positive.union(n.select("query_id", "doc_id", F.lit(0), F.lit("hard_negative")))


@query("pair_group_contract", f"{NEG_SQL}, p AS (SELECT query_id, 1 AS label FROM (SELECT DISTINCT query_id FROM f) UNION ALL SELECT query_id, 0 FROM f WHERE place <= 4) SELECT query_id, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n, sum(label) = 1 AND count(*) > 1 AS ok FROM p GROUP BY query_id")
def pair_group_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One positive a query, and some negative."""
    pairs = training_pairs(spark, sf_dir)
    return pairs.groupBy("query_id").agg(F.sum("label").alias("positives"), F.count("*").alias("n")).withColumn("ok", (F.col("positives") == 1) & (F.col("n") > 1))


sql_query("frozen_query_union", "SELECT item_id AS id, @md5{text} AS text_md5, 'benchmark' AS origin FROM benchmark UNION ALL SELECT doc_id, @md5{text}, 'documents' FROM documents", "U4")
sql_query("training_query_violations", """SELECT 'duplicate_query' AS rule, p_name AS k, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
 UNION ALL SELECT 'contains_code', p_name, count(*) FROM part WHERE @rlike{p_name|'[0-9]'} GROUP BY p_name UNION ALL SELECT 'blank_product', p_name, count(*) FROM part WHERE p_name NOT LIKE '% %' GROUP BY p_name""", "Z16")
sql_query("ambiguous_violations", "SELECT p_name, CASE WHEN count(DISTINCT p_brand) < 2 THEN 'too_few_plausible' WHEN max(p_size) > 49 THEN 'used_as_positive' ELSE 'ok' END AS rule, count(DISTINCT p_brand) AS plausible FROM part GROUP BY p_name", "Z18, D27")
