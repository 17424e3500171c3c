"""Evaluation maths on DataFrames: losses, latencies, stability of ranks and scores, checkpoints, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators.quantiles import with_quantiles


def bce(logit: Column, label: Column) -> Column:
    """Mean binary cross-entropy of logits, in the form that does not overflow."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))


def accuracy(logit: Column, label: Column) -> Column:
    return F.avg(((logit >= 0) == (label == 1)).cast("double"))


def ranknet(rows: DataFrame) -> DataFrame:
    """Mean pairwise loss over the positives and negatives of each query. rows: query_id, label, score."""
    p = rows.where("label = 1").select("query_id", F.col("score").alias("p"))
    n = rows.where("label = 0").select("query_id", F.col("score").alias("n"))
    return p.join(n, "query_id").agg(F.avg(F.log1p(F.exp(F.col("n") - F.col("p")))).alias("loss"))


def pair_ranking(rows: DataFrame) -> DataFrame:
    """hit1, hit3, mrr of queries with one positive each. rows: query_id, code, label, score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
    r = rows.withColumn("r", F.row_number().over(w)).where("label = 1")
    return r.agg(F.count("*").alias("queries"), F.count_if(F.col("r") <= 1).alias("hit1"), F.count_if(F.col("r") <= 3).alias("hit3"), F.avg(1 / F.col("r")).alias("mrr"))


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median and interpolated 95th percentile."""
    return with_quantiles(rows, value, by, {"median": 0.5, "p95": 0.95}, F.count("*").alias("n"), F.avg(value).alias("mean"))


def nearest_percentile(rows: DataFrame, value: str, by: str, p: float, width: float = 1.0) -> DataFrame:
    """The value at rank bround(p * (n - 1)) from 0.

    Values are counted in cells first and only the cell that holds the rank is sorted, so a group of any size is no task's.
    """
    cell = F.floor(F.col(value) / width)
    cells = rows.where(F.col(value).isNotNull()).groupBy(by, cell.alias("cell")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    counted = cells.withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("cell")) - F.col("n"))
    place = F.bround(F.lit(p) * (F.col("total") - 1)).cast("long") - F.col("before")
    target = counted.withColumn("place", place).where("place >= 0 and place < n").select(by, "cell", "place")
    inside = rows.withColumn("cell", cell).join(target, [by, "cell"])
    return inside.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1).where("r = place").select(by, F.col(value).alias("percentile"))


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, extremes, mean, median and sample deviation, 0 for one row."""
    sums = [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")]
    return with_quantiles(rows, value, by, {"median": 0.5}, *sums)


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """The epoch of greatest mrr, then hit1, then least loss, then first."""
    return epochs.orderBy(F.desc("mrr"), F.desc("hit1"), "loss", "epoch").limit(1)


def score_delta(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How far two scores of the same pairs lie apart."""
    d = a.select(*keys, F.col("score").alias("a")).join(b.select(*keys, F.col("score").alias("b")), keys).select(F.abs(F.col("a") - F.col("b")).alias("d"))
    return with_quantiles(d, "d", [], {"median_abs": 0.5}, F.count("*").alias("n"), F.avg("d").alias("mean_abs"), F.max("d").alias("max_abs"), F.count_if(F.col("d") == 0).alias("identical"))


def rank_changes(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 20)) -> DataFrame:
    """For how many queries the first k documents differ in kind or order. a, b: query_id, doc_id, rank."""
    keep = lambda df, name: df.where(F.col("rank") <= max(ks)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id")))["doc_id"].alias(name))  # noqa: E731  at most max(ks) a query
    both = keep(a, "x").join(keep(b, "y"), "query_id", "full_outer")
    differ = lambda k: ~F.slice("x", 1, k).eqNullSafe(F.slice("y", 1, k))
    return both.agg(F.count("*").alias("queries"), *(F.count_if(differ(k)).alias(f"top{k}_changed") for k in ks))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, rho over the common documents, with the positions of the full lists; of fewer than two: 1 if equal, else 0."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("x")).join(b.select("query_id", "doc_id", F.col("rank").alias("y")), ["query_id", "doc_id"])
    g = both.groupBy("query_id").agg(F.count("*").alias("n"), F.sum((F.col("x") - F.col("y")) ** 2).alias("d2"))
    rho = F.when(F.col("n") < 2, (F.col("d2") == 0).cast("double")).otherwise(1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1)))
    found = a.select("query_id").union(b.select("query_id")).distinct().join(g.select("query_id", rho.alias("rho")), "query_id", "left")
    return found.withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def mode_consistency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Size of the largest set of equal values of a group, and its share."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max("n").alias("mode_count"), F.sum("n").alias("total")).withColumn("share", F.col("mode_count") / F.col("total"))


def error_class(pool_rank: Column, rank: Column, function_differs: Column, same_base: Column, subtype_differs: Column, material_differs: Column) -> Column:
    """Seven classes of outcomes, the first that applies."""
    return (
        F.when(rank == 1, "PASS").when(pool_rank.isNull(), "RETRIEVAL_MISS").when(rank.isNull() & ~function_differs & ~same_base, "RERANKER_ERROR").when(same_base, "PART_OR_VARIANT_CONFUSION")
        .when(function_differs, "FUNCTION_CONFUSION").when(subtype_differs, "SUBTYPE_CONFUSION").when(material_differs, "MATERIAL_APPLICATION_CONFUSION").otherwise("RERANKER_ERROR")
    )


def outcome(before: Column, after: Column) -> Column:
    """What became of a rank."""
    return F.when(before.eqNullSafe(after), "unchanged").when(after == 1, "fixed").when(before == 1, "regressed").when(after.isNull() | (after > before), "worsened").otherwise("improved")
