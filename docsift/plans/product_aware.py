"""Product-aware search on orders: the wish is the part of the first line, the pool the others; the oracle reads attributes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.operators import product_aware as P

from .items import NEEDS, stored_docs
from .registry import query

WISHES = {"widget": ("pipe", "pipe_water_drainage"), "ring": ("valve", "water_valve"), "bolt": ("valve", "water_valve")}
SQL = """
a AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS word, string_split(p_name, ' ')[2] AS noun, p_size FROM part),
b AS (SELECT *, CASE noun WHEN 'widget' THEN 'pipe' WHEN 'ring' THEN 'valve' ELSE 'stored' END AS product, p_size % 3 = 0 AS applies,
 CASE noun WHEN 'bolt' THEN 'reduce_pressure' WHEN 'ring' THEN 'prevent_reverse_flow' WHEN 'plate' THEN 'x' WHEN 'rod' THEN 'x' ELSE 'x' END AS does FROM a),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY line, doc_id) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)),
c AS (SELECT d.query_id, d.doc_id, d.rank, CASE x.noun WHEN 'widget' THEN 'pipe' WHEN 'ring' THEN 'valve' WHEN 'bolt' THEN 'valve' END AS wish, y.product, y.noun, y.applies, y.does,
 CASE x.noun WHEN 'widget' THEN 'prevent_reverse_flow' WHEN 'ring' THEN 'prevent_reverse_flow' WHEN 'bolt' THEN 'reduce_pressure' WHEN 'plate' THEN 'release_air' WHEN 'rod' THEN 'release_air' END AS target
 FROM l q JOIN b x ON x.id = q.doc_id JOIN l d ON d.query_id = q.query_id JOIN b y ON y.id = d.doc_id WHERE q.rank = 1 AND d.rank > 1),
f AS (SELECT *, CASE WHEN wish IS NULL THEN 'unknown_query_product' WHEN wish = product THEN 'compatible' WHEN wish = 'pipe' AND applies THEN 'applies_to_family' WHEN wish = 'pipe' AND noun = 'gear' THEN 'compatible' WHEN wish = 'valve' AND noun = 'bolt' THEN 'compatible' ELSE 'incompatible' END AS compatibility,
 CASE WHEN wish IS NULL THEN 'UNKNOWN' WHEN wish = product THEN 'EXACT_PRODUCT' WHEN wish = 'pipe' AND applies THEN 'APPLIES_TO_PRODUCT' ELSE 'CONTRADICTION' END AS state FROM c),
s AS (SELECT *, CASE state WHEN 'EXACT_PRODUCT' THEN 8 WHEN 'APPLIES_TO_PRODUCT' THEN 5 WHEN 'UNKNOWN' THEN 0 ELSE -10 END::DOUBLE AS score, bool_or(compatibility IN ('compatible', 'applies_to_family')) OVER (PARTITION BY query_id) AND wish IS NOT NULL AS gated FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gated AND compatibility = 'incompatible', rank) AS r1 FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(score, 0) DESC, score DESC, r1) AS r2 FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(does = target, false) DESC, r2) AS r3 FROM k WHERE r2 <= 5),
n AS (SELECT *, 1.0::DOUBLE / (60 + rank) + score AS total, row_number() OVER (PARTITION BY query_id ORDER BY score < 0, 1.0::DOUBLE / (60 + rank) + score DESC, r3) AS final FROM m)"""


@query("product_aware_search", f"""WITH {SQL} SELECT query_id, doc_id, final AS rank, compatibility, score AS constraint_score, 'PRODUCT_' || state AS flags, round(total, 6) AS final_score, rank AS pool_rank,
 'product_compatibility=' || compatibility || ';constraint_score=' || score::INT || ';PRODUCT_' || state || ';score_source=rrf_fallback' AS summary, product AS effective_product, 'stored' AS stored_product FROM n""")
def product_aware_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the pool to recommendations with stored against effective values."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.min("l_linenumber").alias("line"))
    lines = lines.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("line", "doc_id")).cast("long"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ")[1].alias("noun"), "p_size")
    of = lambda table, i: P.E.mapped(F.col("noun"), {k: (v if i is None else v[i]) for k, v in table.items()})
    wanted = lines.where("rank = 1").join(part, "doc_id").select("query_id", of(NEEDS, None).alias("description"), of(WISHES, 0).alias("q_product"), of(WISHES, 1).alias("q_family"))
    applies = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("pipe_water_drainage"))).otherwise(F.array().cast("array<string>"))
    docs = stored_docs(spark, sf_dir).withColumnRenamed("p_partkey", "doc_id").join(part.select("doc_id", applies.alias("applies_to")), "doc_id")
    pool = lines.where("rank > 1").withColumn("rrf_score", 1.0 / (60 + F.col("rank")))
    out = P.rank(pool, docs, wanted)
    say = lambda c, sep: F.array_join(c, sep)
    return out.select(
        "query_id", "doc_id", "rank", "compatibility", "constraint_score", say("flags", ",").alias("flags"), F.round("final_score", 6).alias("final_score"), "pool_rank", say("match_summary", ";").alias("summary"),
        F.col("metadata.canonical_product.effective").alias("effective_product"), F.col("metadata.canonical_product.stored").alias("stored_product"),
    )
