"""Titles, retrieval texts, flags and ambiguous products of catalogue records; the oracles read attributes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import texts as X

from .catalogue import BASE, parts
from .learning import N
from .registry import query


@query("reconstructed_titles", f"""WITH {BASE}, {N} SELECT id, CASE WHEN size % 5 IN (0, 1, 3) THEN upper(name) || ' FOR ALL USES' END AS title FROM n""")
def reconstructed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that go on where titles end, or after a title that is cut off; not those that say the same or something else."""
    p, up, k = parts(spark, sf_dir), F.upper("name"), F.col("size") % 5
    whole = F.concat(up, F.lit(" FOR ALL USES"))
    title = F.when(k == 0, up).when(k == 1, F.lit("THINGS FOR ")).when(k == 2, F.lower(whole)).when(k == 3, F.concat(F.lower("name"), F.lit("-for"))).otherwise(F.lit("Things for"))
    return p.select("id", X.reconstructed_title(title, whole).alias("title"))


@query("labelled_texts", f"""WITH {BASE}, {N} SELECT id, concat_ws(chr(10), 'STANDARD: C' || id, 'PRODUCT: ' || product, CASE WHEN wants_use IS NOT NULL THEN 'APPLICATION: ' || wants_use END, 'TYPE: ' || CASE WHEN size % 2 = 0 THEN 'code_of_practice' ELSE 'other' END, 'TITLE: ' || name,
 CASE WHEN size % 3 = 0 THEN 'SCOPE: Covers ' || name || ' of ' || material END) AS retrieval_text FROM n""")
def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven lines, of which those without a value are left out."""
    p, none = parts(spark, sf_dir), F.lit(None).cast("string")
    scope = F.when(F.col("size") % 3 == 0, F.concat(F.lit(" Covers  "), "name", F.lit("\nof "), "wants_material"))
    text = X.retrieval_text(F.concat(F.lit("C"), "id"), F.col("product"), none, F.lit(" "), F.lit(""), none, F.col("wants_use"), F.when(F.col("size") % 2 == 0, "code_of_practice"), F.col("name"), scope, F.lit(" \n "))
    return p.select("id", text.alias("retrieval_text"))


@query("record_flags", f"""WITH {BASE} SELECT id, concat_ws(',', CASE WHEN size % 2 = 0 THEN 'missing_title' END, CASE WHEN size % 3 = 0 THEN 'missing_scope' END, CASE WHEN size % 7 = 0 THEN 'missing_full_text' END, CASE WHEN size % 5 = 0 THEN 'low_product_confidence' END,
 CASE WHEN grade IS NULL THEN 'missing_primary_subject' END, CASE WHEN word = 'hot' THEN 'metadata_review_required' END, CASE WHEN size % 4 > 1 THEN 'duplicate_source_records' END) AS flags FROM a""")
def record_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all seven flags."""
    p, s = parts(spark, sf_dir), F.col("size")
    word = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.split("p_name", " ")[0] == "hot").alias("review"))
    flags = X.quality_flags(F.when(s % 2 != 0, F.col("title")), F.when(s % 3 == 0, " ").otherwise("x"), F.when(s % 7 == 0, "").otherwise("x"), F.when(s % 5 == 0, "low").otherwise("high"), F.col("grade"), F.col("review"), F.when(s % 4 != 0, s % 4))
    return p.join(word, "id").select("id", F.array_join(flags, ",").alias("flags"))


@query("ambiguous_products", f"""WITH {BASE}, k AS (SELECT id, CASE WHEN size % 4 <> 0 THEN product ELSE family END AS key FROM a WHERE size % 6 <> 0),
f AS (SELECT key, 'C' || id AS code, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k)
SELECT key, 'Need ' || replace(key, '_', ' ') || ' standard' AS query, array_to_string(list_sort(list(code)), ',') AS plausible FROM f WHERE n <= 8 GROUP BY key HAVING count(*) > 1 ORDER BY key LIMIT 50""")
def ambiguous_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and families that several records share."""
    p = parts(spark, sf_dir).select(F.col("id").alias("place"), F.concat(F.lit("C"), "id").alias("code"), F.when(F.col("size") % 4 != 0, F.col("product")).alias("product"), F.lit("").alias("subtype"), "family", (F.col("size") % 6 == 0).alias("review"))
    return X.ambiguous(p).withColumn("plausible", F.array_join("plausible", ","))
