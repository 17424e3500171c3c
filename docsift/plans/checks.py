"""A training set written with its checks in the write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import checks as K
from docsift.session import shared_folder

from .registry import query


@query("checked_training_set", """WITH p AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS label FROM lineitem)
SELECT count(*) AS n_pairs, sum(label)::BIGINT AS n_positives, count(DISTINCT doc_id) AS n_documents, sum(doc_id)::BIGINT AS doc_sum FROM p""")
def checked_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without leaks or odd labels and with as many positives as there are orders, published and read again."""
    lines, items = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = lines.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("order "), "l_orderkey").alias("query"), F.col("l_partkey").alias("doc_id"), F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("label"))
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    rules = {"label is 0 or 1": F.col("label").isin(0, 1), "document has an id": F.col("doc_id").isNotNull()}
    totals = {"n_pairs": F.count("*"), "n_positives": F.sum("label")}
    told = K.write_checked(K.without_leaks(pairs, items), path, rules, F.col("query_id"), totals, {"n_positives": lambda n: n > 0})
    back = K.read_checked(spark, path).agg(F.count_distinct("doc_id").alias("n_documents"), F.sum("doc_id").cast("long").alias("doc_sum"))
    return back.select(F.lit(told["n_pairs"]).cast("long").alias("n_pairs"), F.lit(told["n_positives"]).cast("long").alias("n_positives"), "n_documents", "doc_sum")
