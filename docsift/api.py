"""Batch entry points: search for many requirements at once, and analysis of many documents at once.

Stages are columns and joins, so that one job answers all queries; policies of the online service (skipped rerankers,
timeouts) are told in the column score_source instead of being acted out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import constraints, details, facts, intent, product_aware, retrieval


def check_request(queries: DataFrame, text: str, limit: int, longest: int = 5000, most: int = 30) -> None:
    """a positive limit of `most` at most, no blank query, none longer than `longest`."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    t = F.coalesce(F.trim(text), F.lit(""))
    if queries.where((t == "") | (F.char_length(t) > longest)).limit(1).count():
        raise ValueError(f"queries must be 1 to {longest} characters long")


def search(docs: DataFrame, queries: DataFrame, limit: int = 5, dense: DataFrame | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, doc_id, rank, score, score_source. docs: doc_id, text; queries: query_id, text; dense: a ranked list."""
    check_request(queries, "text", limit)
    lexical = retrieval.Bm25Index(docs, "doc_id", "text", queries, "query_id", "text").search()
    if dense is None:
        dense = lexical.limit(0)
    fused = retrieval.rrf(dense.select("query_id", "doc_id", "rank"), lexical.select("query_id", "doc_id", "rank"), limit=max(10, limit))
    pool = fused.select("query_id", "doc_id", F.col("rank").alias("rrf_rank"), "rrf_score")
    ranked = retrieval.rerank(pool, scorer or F.col("rrf_score"), limit)
    return ranked.select("query_id", "doc_id", "rank", "score", F.lit("reranker" if scorer else "rrf_fallback").alias("score_source"))


def product_search(docs: DataFrame, queries: DataFrame, vocabulary: DataFrame, families: DataFrame, limit: int = 5, pool: int = 30, **how) -> DataFrame:
    """query_id, doc_id, rank, final_score, constraint_score, flags, compatibility: search, then intent, gate and constraints.

    docs: doc_id, text, title, scope, product, family and any attribute that constraints know; vocabulary: field, value, phrase,
    ord (intent.values; the field product tells the product wanted); families: product, family; how: as for search(). The pool
    is searched first; what contradicts the intent comes last, whatever its score.
    """
    check_request(queries, "text", limit)
    found = search(docs.select("doc_id", "text"), queries, max(pool, limit), **how)
    wanted = intent.intents(queries, vocabulary).withColumn("q_product", F.get("q_product", F.lit(0)))
    wanted = wanted.join(families.select(F.col("product").alias("q_product"), F.col("family").alias("q_family")), "q_product", "left").drop("text")
    rows = found.drop("score_source").join(docs.drop("text"), "doc_id").join(wanted, "query_id")
    fit = constraints.compatibility(F.col("q_product"), F.col("product"), F.col("q_family"), F.col("family"))
    gated = constraints.gate(rows.withColumn("compatibility", fit), F.col("compatibility")).drop("rank").withColumnRenamed("gated_rank", "rank")
    final = constraints.final_order(constraints.score(gated), "score").where(F.col("final_rank") <= limit)
    return final.select("query_id", "doc_id", F.col("final_rank").alias("rank"), "final_score", "constraint_score", "flags", "compatibility")


def recommend(docs: DataFrame, queries: DataFrame, vocabulary: DataFrame, families: DataFrame, limit: int = 5, pool: int = 30, dense: DataFrame | None = None, traced: bool = False) -> DataFrame:
    """The whole way of a requirement: both searches, fusion, intent, effective values, gate, constraints, final order, match summary.

    docs: doc_id, text, applies_to and stored metadata (product_aware.prepared); queries: query_id, text; vocabulary, families: as for
    product_search; dense: a ranked list (query_id, doc_id, rank, score). Rows of product_aware.rank, or with traced one row a query of
    product_aware.trace.
    """
    check_request(queries, "text", limit)
    lexical = retrieval.Bm25Index(docs, "doc_id", "text", queries, "query_id", "text").search()
    dense = lexical.limit(0) if dense is None else dense
    found = retrieval.rrf(dense.select("query_id", "doc_id", "rank"), lexical.select("query_id", "doc_id", "rank"), limit=max(pool, limit))
    wanted = intent.intents(queries, vocabulary).withColumn("q_product", F.get("q_product", F.lit(0))).withColumnRenamed("text", "description")
    wanted = wanted.join(families.select(F.col("product").alias("q_product"), F.col("family").alias("q_family")), "q_product", "left")
    ranked = product_aware.rank(found, docs, wanted, limit)
    if not traced:
        return ranked
    return product_aware.trace(found.select("query_id", "doc_id", "rank", F.col("rrf_score").alias("score")), ranked, dense, lexical, docs)


def analyze(documents: DataFrame) -> DataFrame:
    """doc_id, description, facts (sizes, temperatures, addresses) and details (typed technical facts) of each document (doc_id, text)."""
    text = F.col("text")
    return documents.select(
        "doc_id", T.excerpt(F.array_join(F.slice(T.sentences(text), 1, 2), " "), 240).alias("description"), facts.extract_facts(text).alias("facts"), details.extract_details(text).alias("details")
    )
