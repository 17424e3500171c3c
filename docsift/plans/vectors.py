"""Queries of embedders and the vector sink on catalogue texts, with oracles from attributes and from the words alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import vectors as V
from docsift.session import shared_folder

from .catalogue import BASE, PRODUCTS, _sql_map, parts, records
from .registry import query

DIMENSION = 64
_NAME = _sql_map("string_split(p_name, ' ')[2]", PRODUCTS, 2)
TITLES = f"""t AS (SELECT p_partkey AS id, replace(CASE p_size % 6 WHEN 0 THEN 'Methods of test for %s' WHEN 1 THEN 'Code of practice for %s' WHEN 2 THEN 'Glossary of terms on %s' WHEN 3 THEN 'Laying of %s' WHEN 4 THEN 'All about %s' ELSE 'On %s' END, '%s', {_NAME}) AS title FROM part)"""


def _small() -> V.HashingEmbedder:
    return V.HashingEmbedder(DIMENSION)


@query("embed_texts", f"""WITH {TITLES}, w AS (SELECT id, md5(unnest(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS h FROM t),
d AS (SELECT id, ('0x' || substring(h, 1, 8))::BIGINT % {DIMENSION} AS dim, sum(CASE WHEN substring(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY ALL)
SELECT id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 5) AS value FROM d WHERE x <> 0""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: every title embedded, its components that are not zero."""
    v = V.embed(records(spark, sf_dir).select("id", "title"), "title", _small).select("id", F.posexplode("vector").alias("dim", "value"))
    return v.where("value <> 0").select("id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the sink: of every other part the product is in the profile alone, of every seventh there is no profile."""
    p = records(spark, sf_dir).select("id", "title").join(parts(spark, sf_dir).select("id", "size", "product", "family", "wants_use"), "id")
    profile = F.to_json(F.struct(F.col("product").alias("canonical_product"), F.col("family").alias("family"), F.array("family").alias("product_family"), F.array_compact(F.array("wants_use")).alias("applications")))
    own = lambda c: F.when(F.col("size") % 2 == 1, F.col(c))
    code = F.concat(F.lit("C "), "id")
    return p.select("id", code.alias("code"), F.upper(code).alias("canonical_id"), "title", own("product").alias("product"), F.lit("other").alias("standard_kind"), own("family").alias("family"), F.when(F.col("size") % 7 != 0, profile).alias("profile"), F.col("title").alias("text"), "size")


@query("vector_points", f"""WITH {BASE}, {TITLES} SELECT id::VARCHAR AS standard_id, 'C ' || id AS standard_code, 'C ' || id AS canonical_id, title, CASE WHEN size % 2 = 1 OR size % 7 <> 0 THEN product END AS canonical_product, 'other' AS standard_kind,
 CASE WHEN size % 2 = 1 OR size % 7 <> 0 THEN family END AS family, CASE WHEN size % 7 <> 0 THEN family ELSE '' END AS product_family, CASE WHEN size % 7 <> 0 THEN coalesce(wants_use, '') ELSE '' END AS applications, 'catalogue' AS source_dataset FROM a JOIN t USING (id)""")
def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten fields of each point, with the profile's where the record has none."""
    p = _points(spark, sf_dir)
    out = p.select(V.payload(p, "catalogue").alias("p")).select("p.*")
    return out.withColumn("product_family", F.array_join("product_family", ",")).withColumn("applications", F.array_join("applications", ","))


@query("vector_sink", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_size % 10 = 0) AS changed, count(*) FILTER (p_size % 10 = 1) AS moved FROM part)
SELECT 1 AS run, n AS expected, n AS embedded, n AS written, n AS records FROM n UNION ALL SELECT 2, n, 0, 0, n FROM n UNION ALL SELECT 3, n, changed, changed + moved, n FROM n""")
def vector_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts of all parts: as they are, again, and with some texts and some payloads changed."""
    p = _points(spark, sf_dir)
    sink = V.VectorSink(spark, f"{shared_folder(spark)}/points-{uuid.uuid4().hex}", "catalogue")
    text = F.when(F.col("size") % 10 == 0, F.concat("text", F.lit(", revised"))).otherwise(F.col("text"))
    changed = p.withColumn("text", text).withColumn("title", F.when(F.col("size") % 10 == 1, F.lit("moved")).otherwise(F.col("title")))
    reports = [sink.upsert(x, _small, "small") for x in (p, p, changed)]
    names = ("expected", "embedded", "written", "records")
    return spark.createDataFrame([(i, *(r[c] for c in names)) for i, r in enumerate(reports, 1)], "run int, expected long, embedded long, written long, records long")
