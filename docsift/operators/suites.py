"""Suites of cases evaluated for several systems in one pass, the ranks of watched documents side by side, and A/B decisions.

All systems' results are one long table. Each case has one row a system, made by one aggregation; rates of systems, suites and
families come from GROUPING SETS over these rows, so neither a suite nor a system costs a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS, RECALLS, TOP = (1, 3, 5, 10), (5, 10, 20), 5


def case_rows(results: DataFrame, cases: DataFrame, systems: list[str], top: int = TOP) -> DataFrame:
    """system, query_id, suite, family, rank (of the expected document), pool (results), cross_product, contradiction, expected.

    results: system, query_id, doc_id, rank, compatibility, contradicts; cases: query_id, suite, family, expected. A case of which a
    system finds nothing is a miss of it. cross_product: the first result is of an incompatible product; contradiction: one of the
    first `top` contradicts the request; both are false if the case knows neither.
    """
    named = cases.sparkSession.createDataFrame([(s,) for s in systems], "system string")
    every = cases.select("query_id", "suite", "family", "expected").crossJoin(F.broadcast(named))  # the systems, few by nature
    met = results.where(F.col("system").isin(*systems)).join(cases.select("query_id", F.col("expected").alias("e")), "query_id")
    at = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    told = met.groupBy("system", "query_id").agg(
        F.min(F.when(F.col("doc_id") == F.col("e"), F.col("rank"))).alias("rank"), F.count("*").alias("pool"),
        at((F.col("rank") == 1) & (F.col("compatibility") == "incompatible")).alias("cross_product"), at((F.col("rank") <= top) & F.col("contradicts")).alias("contradiction"),
    )
    none = {"pool": 0, "cross_product": False, "contradiction": False}
    return every.join(told, ["system", "query_id"], "left").na.fill(none)


def evaluate(rows: DataFrame) -> DataFrame:
    """Rates of each system, suite of it, and family of that; suite and family are null in totals, and level tells which (0 all, 1 suite, 2 family).

    rows: of case_rows(). Found is the share of cases whose expected document is in the pool at all.
    """
    hit = lambda k: F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"hit{k}")
    recall = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall{k}")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    sums = [
        F.count("*").alias("cases"), *map(hit, HITS), *map(recall, RECALLS), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), share(F.col("rank").isNotNull()).alias("found"),
        F.count_if("cross_product").alias("cross_product_errors"), F.count_if("contradiction").alias("contradictions"), share(F.col("contradiction")).alias("contradiction_rate"),
        F.when(F.grouping("suite") == 1, 0).when(F.grouping("family") == 1, 1).otherwise(2).alias("level"),
    ]
    sets = [[F.col("system")], [F.col("system"), F.col("suite")], [F.col("system"), F.col("suite"), F.col("family")]]
    return rows.groupingSets(sets, "system", "suite", "family").agg(*sums)


def presence(results: DataFrame, watched: DataFrame, systems: list[str], most: int = 20) -> DataFrame:
    """query_id, doc_id and a column for each system: the rank of a watched document among its first results, null if it is not there."""
    met = watched.select("query_id", "doc_id").distinct().join(results.where(F.col("rank") <= most).select("query_id", "doc_id", "system", "rank"), ["query_id", "doc_id"], "left")
    return met.groupBy("query_id", "doc_id").pivot("system", systems).agg(F.min("rank"))


def preserved(rows: DataFrame, before: str, after: str) -> DataFrame:
    """suite, and how many cases of it a change fixed, lost, kept or left missed; keep: better by mrr, and no first place lost. rows: of case_rows()."""
    met = rows.where(F.col("system").isin(before, after)).groupBy("suite", "query_id").pivot("system", [before, after]).agg(F.min("rank"))
    b, a = F.col(f"`{before}`"), F.col(f"`{after}`")
    mrr = lambda r: F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0)))
    first = lambda r: F.coalesce(r == 1, F.lit(False))
    out = met.groupBy("suite").agg(
        F.count_if(first(a) & ~first(b)).alias("fixed"), F.count_if(first(b) & ~first(a)).alias("lost"), F.count_if(first(a) & first(b)).alias("kept"), F.count_if(a.isNull()).alias("missed"),
        F.round(mrr(a) - mrr(b), 6).alias("mrr_delta"),
    )
    return out.withColumn("keep", (F.col("mrr_delta") > 0) & (F.col("lost") == 0))
