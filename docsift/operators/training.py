"""Training data for rerankers: who may be learned from, hard negatives, splits, leakage and the checks of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import joins
from docsift.operators.negatives import hard_negatives  # noqa: F401  mined with the rest of the training data

UNSAFE = ["merged_artifact", "conflicting_duplicate", "missing_scope"]
NON_PRODUCT = ["test_method", "code_of_practice", "terminology", "installation"]


def eligibility(review: Column, flags: Column, kind: Column, subject: Column, product: Column, subtype: Column, confidence: Column, grounded: Column) -> Column:
    """The first reason not to learn from a record, else SAFE_FOR_TRAINING."""
    return (
        F.when(review, "NEEDS_REVIEW").when(F.arrays_overlap(flags, F.array(*map(F.lit, UNSAFE))), "UNSAFE_FLAGS").when(kind.isin(*NON_PRODUCT), "SEARCH_ONLY_KIND").when(subject.isNull(), "NO_SUBJECT")
        .when(product.isNull() & subtype.isNull(), "NO_PRODUCT").when(confidence == "low", "LOW_CONFIDENCE").when(~grounded, "NO_GROUNDING").otherwise("SAFE_FOR_TRAINING")
    )


def split(rows: DataFrame, key: str, share: float = 0.15, seed: int = 5108) -> DataFrame:
    """rows with the column split: a hash of seed and key decides, so that a row keeps its side when others come or go (M6)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(h < share, "validation").otherwise("train"))


def leakage(train: DataFrame, frozen: DataFrame, near: float = 0.90) -> DataFrame:
    """train_id, frozen_id, kind (exact, near): training texts that a frozen set holds, or nearly. Both: id, text."""
    key = T.leakage_key(F.col("text"))
    exact = train.select(F.col("id").alias("train_id"), key.alias("k")).join(frozen.select(F.col("id").alias("frozen_id"), key.alias("k")), "k").select("train_id", "frozen_id", F.lit("exact").alias("kind"))
    side = lambda df, s: df.select(F.struct(F.lit(s).alias("s"), F.col("id").alias("i")).alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("s"))
    pairs = joins.jaccard_pairs(side(train, 0).union(side(frozen, 1)), near).where("a.s = 0 and b.s = 1")
    close = pairs.select(F.col("a.i").alias("train_id"), F.col("b.i").alias("frozen_id")).join(exact, ["train_id", "frozen_id"], "left_anti")
    return exact.union(close.select("train_id", "frozen_id", F.lit("near")))


def pair_violations(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """rule, query_id of pairs (query_id, query, doc_id, label) that break the contract."""
    by = pairs.groupBy("query_id").agg(F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_distinct("query").alias("texts"))
    twice = pairs.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "query_id")
    found = [
        rule(by.where("pos <> 1"), "not_one_positive"), rule(by.where("neg = 0"), "no_negatives"), rule(by.where("texts > 1"), "query_mismatch"),
        rule(twice.where("n > 1"), "duplicate_pair"), rule(twice.where("labels > 1"), "positive_as_negative"), rule(pairs.join(docs.select("doc_id"), "doc_id", "left_anti"), "missing_document"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()
