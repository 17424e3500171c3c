"""From raw documents to packed training sequences: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage takes what its predecessor kept; the first four return the columns of documents. Which rows stay is told by
ids: a small set of ids to drop is broadcast after a check of its size, a large one joined by shuffle.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm import common, decontaminate, minhash, packing, substring, toxicity


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows with these ids; rows without an id stay."""
    gone = common.free(docs, "_gone")
    ids = common.cut(ids.select(F.col("doc_id").cast("long").alias(gone)).distinct(), files=common.files_for(docs.count()))
    few = ids.count() <= minhash.BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Null and empty texts have no toxic words and stay; rows that repeat are told one by one;
    without documents nothing is left, without labels nothing goes; other columns are kept as they are."""
    labels = toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    out = common.free(docs, "_toxicity")
    return toxicity.score(docs, model, out).where(F.col(out) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    Null and empty texts are copies of nothing and stay, as do rows without doc_id; of rows that repeat doc_id and text one
    stays; different texts under one doc_id are one document, and stay or go together.
    """
    told = common.cut(minhash.near_duplicates(docs, n=5).select("doc_id", "kept"), files=common.files_for(docs.count()))
    twice = told.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    stay = _without(docs, told.where("not kept").select("doc_id"))
    if not twice.limit(1).count():
        return stay
    of, n, key = common.free(docs, "_twice"), common.free(docs, "_n"), F.sha2(F.col("text").cast("string"), 256)
    again = stay.join(twice.select(F.col("doc_id").alias(of)), F.col("doc_id").cast("long") == F.col(of), "left_semi")
    first = again.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", key).orderBy("doc_id"))).where(F.col(n) == 1).drop(n)
    return _without(stay, twice).unionByName(first)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a passage go from their texts; a document of which nothing else is left goes too.

    Null and empty texts stay; rows that repeat doc_id and text lose nothing to each other; n_chars, if there, follows the text.
    """
    spans, removed = common.free(docs, "_spans"), common.free(docs, "_removed")
    out = substring.dedup_substrings(docs, spans=spans, removed=removed)
    blank = F.col(spans).isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = out.where(~blank)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go, and so do all rows of their doc_id. Null and empty texts hold none;
    rows without doc_id stay; without items nothing goes."""
    return _without(docs, decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("doc_id is not null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed; a null or empty text is one piece of the end id alone; without documents there is no sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL has no word for most of these stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), old=[docs])  # a stage's input goes once its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
