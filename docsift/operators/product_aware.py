"""Product-aware ranking of a searched pool: effective values, metadata-aware compatibility, gate, constraints, function first, final order.

Every step is a column or a window over the pool of a query, so a batch of queries is one job with two joins: the pool with the documents'
effective values, told once a document, and with the queries' wishes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import constraints as C
from docsift.operators import effective as E

#: Effective fields, and the names by which constraints know them.
NAMES = {"canonical_product": "product", **{f: f for f in E.FIELDS if f != "canonical_product"}}
SUBJECT = ["primary_subject", "product_subtype", "material", "application", "function", "title"]
FITS = ["compatible", "adjacent", "same_family", "applies_to_family"]


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, title, scope, retrieval_text, applies_to, the effective values by their constraint names, and metadata (stored against effective).

    docs: doc_id, applies_to (families) and what effective() asks.
    """
    e = E.effective(docs)
    pair = lambda f: F.struct((F.col(f) if f in docs.columns else F.lit(None).cast("string")).alias("stored"), F.col(f"effective_{f}").alias("effective")).alias(f)
    metadata = F.struct(*(pair(f) for f in E.FIELDS))
    return e.select("doc_id", "title", F.col("scope_text").alias("scope"), "retrieval_text", "applies_to", *(F.col(f"effective_{f}").alias(n) for f, n in NAMES.items()), metadata.alias("metadata"))


def compatibility(rows: DataFrame) -> Column:
    """The lattice of products; what it calls incompatible fits if it applies to the family, is of it, or names the product in its words."""
    base = C.compatibility(F.col("q_product"), F.col("product"), F.col("q_family"), F.col("family"))
    applies = F.coalesce(F.array_contains("applies_to", F.col("q_family")), F.lit(False))
    words = T.dash_key(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in SUBJECT)))
    named = T.contains_phrase(words, T.dash_key(F.col("q_product")))
    same = F.coalesce(F.col("family") == F.col("q_family"), F.lit(False))
    return F.when(base != "incompatible", base).when(applies, "applies_to_family").when(same, "same_family").when(named, "compatible").otherwise(base)


def gate(rows: DataFrame) -> DataFrame:
    """rows in the order of rank, what fits first, then unknown products, then the rest; as they were if nothing fits or no product is wanted."""
    query = Window.partitionBy("query_id")
    fits = F.col("compatibility").isin(*FITS)
    any_ = F.bool_or(fits).over(query) & F.col("q_product").isNotNull()
    bucket = F.when(~any_ | fits, 0).when(F.startswith("compatibility", F.lit("unknown")), 1).otherwise(2)
    out = rows.withColumn("_bucket", bucket)
    return out.withColumn("gated_rank", F.row_number().over(query.orderBy("_bucket", "rank"))).drop("_bucket")


def function_first(rows: DataFrame, rank: str) -> DataFrame:
    """function_rank: candidates of the function that the description asks for come first, if there are any."""
    match = F.coalesce(F.col("function") == F.col("target_function"), F.lit(False))
    return rows.withColumn("function_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(~match, rank)))


def summary(fit: Column, score: Column, flags: Column, source: Column) -> Column:
    """What a match is told by: compatibility, score, the first six flags, the source of the score."""
    number = F.regexp_replace(F.round(score, 5).cast("string"), r"\.0$", "")
    head = F.array(F.concat(F.lit("product_compatibility="), fit), F.concat(F.lit("constraint_score="), number))
    return F.array_compact(F.concat(head, F.slice(flags, 1, 6), F.array(F.concat(F.lit("score_source="), source))))


def rank(pool: DataFrame, docs: DataFrame, wanted: DataFrame, limit: int = 5, base: str = "rrf_score", source: str = "rrf_fallback") -> DataFrame:
    """query_id, doc_id, rank, title, compatibility, constraint_score, flags, final_score, match_summary, pool_rank and metadata of the best.

    pool: query_id, doc_id, rank and the score base; docs: as for prepared(); wanted: query_id, description, q_product, q_family and what
    constraints.score knows of intents. Documents that docs lacks drop out. What contradicts a wish comes last, whatever its score.
    """
    wishes = wanted.withColumn("target_function", E.description_function(F.coalesce("description", F.lit(""))))
    rows = pool.select("query_id", "doc_id", "rank", base).join(prepared(docs), "doc_id").join(wishes, "query_id")
    gated = gate(rows.withColumn("compatibility", compatibility(rows)))
    scored = C.score(gated.withColumnRenamed("rank", "pool_rank").withColumnRenamed("gated_rank", "rank"))
    kept = C.order(scored).where(F.col("constraint_rank") <= limit)
    first = function_first(kept, "constraint_rank").drop("rank").withColumnRenamed("function_rank", "rank")
    final = C.final_order(first, base)
    told = summary(F.col("compatibility"), F.col("constraint_score"), F.col("flags"), F.lit(source))
    return final.select("query_id", "doc_id", F.col("final_rank").cast("long").alias("rank"), "title", "compatibility", "constraint_score", "flags", "final_score", told.alias("match_summary"), "pool_rank", "metadata")


def trace(pool: DataFrame, ranked: DataFrame, dense: DataFrame, lexical: DataFrame, docs: DataFrame, top: int = 20, best: int = 10) -> DataFrame:
    """One row a query: the first `top` of both searches, the pool and the final `best`, with stored against effective values.

    Lists are bounded by the pool of a query. pool, dense, lexical: query_id, doc_id, rank, score; docs: as for prepared().
    """
    titles = docs.select("doc_id", "title")
    meta = prepared(docs).select("doc_id", "metadata")
    listed = lambda df, name, *c: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", *c))).alias(name))
    first = lambda df: df.where(F.col("rank") <= top).select("query_id", "doc_id", "rank", "score").join(titles, "doc_id", "left")
    parts = [
        listed(first(dense), "semantic_top", "title", "score"), listed(first(lexical), "bm25_top", "title", "score"),
        listed(pool.join(meta, "doc_id", "left"), "pool", "score", "metadata"), listed(ranked.where(F.col("rank") <= best), "final_top", "title", "final_score", "metadata"),
    ]
    out = parts[2]
    for p in (parts[0], parts[1], parts[3]):
        out = out.join(p, "query_id", "left")
    return out
