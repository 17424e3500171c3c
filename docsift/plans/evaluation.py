"""Evaluation analytics on the driver tables: counts, distributions, losses, stability and decisions.

orders by month stand for training epochs, events for measured latencies, customers' orders for queries with a positive
(status F) and negatives, parts for documents with two scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import evaluation as E

from .dialect import render, sql_query
from .registry import query

sql_query("value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source", "G6")
GROUP_SIZES = "SELECT count(*) AS groups, min(n) AS smallest, median(n) AS median_size, max(n) AS largest FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) AS g"


@query("group_size_distribution", render(GROUP_SIZES, True))
def group_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median by distributed selection."""
    sizes = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n"))
    d = E.distribution(sizes, "n", [])
    return d.select(F.col("n").alias("groups"), F.col("min").alias("smallest"), F.col("median").alias("median_size"), F.col("max").alias("largest"))


LATENCY = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(@pct{value|0.95}, 6) AS p95_ms FROM events GROUP BY event_type"


@query("latency_summary", render(LATENCY, True))
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and 95th percentile by distributed selection."""
    d = E.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])
    return d.select("event_type", "n", *(F.round(c, 6).alias(f"{c}_ms") for c in ("mean", "median", "p95")))


sql_query(
    "percentile_nearest",
    """WITH b AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS cell, count(*) AS n FROM events GROUP BY event_type, CAST(floor(value) AS BIGINT)),
 c AS (SELECT event_type, cell, n, sum(n) OVER (PARTITION BY event_type ORDER BY cell) - n AS before, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
 t AS (SELECT event_type, cell, @bround{0.95e0 * (total - 1)} - before + 1 AS place FROM c WHERE @bround{0.95e0 * (total - 1)} >= before AND @bround{0.95e0 * (total - 1)} < before + n),
 r AS (SELECT e.event_type, value, place, @rank{PARTITION BY e.event_type ORDER BY value} AS k FROM events e JOIN t ON e.event_type = t.event_type AND CAST(floor(e.value) AS BIGINT) = t.cell)
 SELECT event_type, value AS p95 FROM r WHERE k = place""",
    "G13: nearest rank with bankers' rounding; only the cell that holds the rank is sorted",
)
DISTRIBUTION = "SELECT lang, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS mid, round(coalesce(stddev_samp(n_chars), 0), 6) AS sd FROM documents GROUP BY lang"


@query("score_distribution", render(DISTRIBUTION, True))
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median by distributed selection."""
    d = E.distribution(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", ["lang"])
    return d.select("lang", "n", F.col("min").alias("low"), F.col("max").alias("high"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("mid"), F.round("sd", 6).alias("sd"))


LOGIT = "SELECT l.doc_id, l.quality AS y, (d.n_chars % 701) / 100e0 - 3e0 AS x FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
sql_query("bce_logits", f"SELECT round(avg(greatest(x, 0e0) - x * y + ln(1e0 + exp(-abs(x)))), 6) AS loss FROM ({LOGIT}) AS p", "G15")
sql_query("pair_accuracy", f"SELECT round(avg(CASE WHEN (x >= 0 AND y = 1) OR (x < 0 AND y = 0) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM ({LOGIT}) AS p", "G15")
sql_query(
    "ranknet_loss",
    """SELECT count(*) AS pairs, round(avg(ln(1e0 + exp(-(p.s - n.s)))), 6) AS loss FROM (SELECT o_custkey, o_totalprice / 100000e0 AS s FROM orders WHERE o_orderstatus = 'F') p
 JOIN (SELECT o_custkey, o_totalprice / 100000e0 AS s FROM orders WHERE o_orderstatus <> 'F') n ON p.o_custkey = n.o_custkey""",
    "G16",
)
EPOCHS = "SELECT year(o_orderdate) * 12 + month(o_orderdate) AS epoch, round(avg(o_totalprice) / 300000, 6) AS mrr, round(avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1e0 ELSE 0e0 END), 6) AS hit1, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1e0 ELSE 0e0 END), 6) AS loss FROM orders GROUP BY year(o_orderdate) * 12 + month(o_orderdate)"
sql_query("best_checkpoint", f"SELECT epoch, mrr, hit1, loss FROM ({EPOCHS}) AS e ORDER BY mrr DESC, hit1 DESC, loss, epoch LIMIT 1", "G17")
sql_query("first_last_delta", f"SELECT round(@best{{mrr|epoch}} - @first{{mrr|epoch}}, 6) AS mrr_delta, round(@best{{loss|epoch}} - @first{{loss|epoch}}, 6) AS loss_delta FROM ({EPOCHS}) AS e", "G26")
sql_query("epoch_lag_check", f"SELECT epoch, mrr, loss, mrr < lag(mrr) OVER (ORDER BY epoch) AND loss > lag(loss) OVER (ORDER BY epoch) AS overfit FROM ({EPOCHS}) AS e", "W18; a row an epoch")
sql_query("recommend_k", f"SELECT min(epoch) AS k FROM (SELECT epoch, hit1, mrr, max(hit1) OVER () AS top, max(mrr) OVER () AS best FROM ({EPOCHS}) AS e) AS w WHERE hit1 >= top - 0.1 AND mrr >= best - 0.1", "W19")
SCORES = "SELECT p_partkey, p_brand, round(p_retailprice, 2) AS before_score, round(p_retailprice + CASE WHEN p_size % 4 = 0 THEN 0 ELSE (p_size - 25) * 0.5 END, 2) AS after_score FROM part"


@query("score_delta", render(f"SELECT count(*) AS n, round(avg(abs(after_score - before_score)), 6) AS mean_abs, round(median(abs(after_score - before_score)), 6) AS median_abs, round(max(abs(after_score - before_score)), 6) AS max_abs, @if{{after_score = before_score}} AS identical FROM ({SCORES}) AS s", True))
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median difference by distributed selection."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    before = F.round("p_retailprice", 2)
    after = F.round(F.col("p_retailprice") + F.when(F.col("p_size") % 4 == 0, 0).otherwise((F.col("p_size") - 25) * 0.5), 2)
    d = E.score_delta(p.select("p_partkey", before.alias("score")), p.select("p_partkey", after.alias("score")), ["p_partkey"])
    return d.select("n", *(F.round(c, 6).alias(c) for c in ("mean_abs", "median_abs", "max_abs")), "identical")


RANKS = f"SELECT p_brand, p_partkey, @rank{{PARTITION BY p_brand ORDER BY before_score DESC, p_partkey}} AS r0, @rank{{PARTITION BY p_brand ORDER BY after_score DESC, p_partkey}} AS r1 FROM ({SCORES}) AS s"
sql_query(
    "rank_change",
    f"SELECT @if{{m1 > 0}} AS top1_changed, @if{{m3 > 0}} AS top3_changed, @if{{m5 > 0}} AS top5_changed, @if{{mk > 0}} AS top20_changed, count(*) AS queries FROM (SELECT p_brand, @if{{least(r0, r1) <= 1 AND r0 <> r1}} AS m1, @if{{least(r0, r1) <= 3 AND r0 <> r1}} AS m3, @if{{least(r0, r1) <= 5 AND r0 <> r1}} AS m5, @if{{least(r0, r1) <= 20 AND r0 <> r1}} AS mk FROM ({RANKS}) AS r GROUP BY p_brand) AS c",
    "G19: two lists differ in their first k places if a document of either has another rank there",
)
sql_query("spearman_lists", f"SELECT p_brand, CASE WHEN n < 2 THEN CASE WHEN d2 = 0 THEN 1e0 ELSE 0e0 END ELSE round(1e0 - 6e0 * d2 / (n * (n * n - 1e0)), 6) END AS rho FROM (SELECT p_brand, count(*) AS n, @sum{{(r0 - r1) * (r0 - r1)}} AS d2 FROM ({RANKS}) AS r GROUP BY p_brand) AS c", "G20")
sql_query("mode_consistency", "SELECT user_id, max(n) AS mode_count, @sum{n} AS total, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS consistency FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) AS c GROUP BY user_id", "G21")
sql_query("weighted_delta", f"SELECT round(sum(d * n) / sum(n), 6) AS delta FROM (SELECT p_brand, avg(after_score) - avg(before_score) AS d, count(*) AS n FROM ({SCORES}) AS s GROUP BY p_brand) AS b", "G22")
sql_query("keyword_sets", "SELECT l_orderkey, @join{@set{p_brand}|';'} AS keywords FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey", "G25")
sql_query("pair_ranking_metrics", """SELECT count(*) AS queries, @if{r <= 1} AS hit1, @if{r <= 3} AS hit3, round(avg(1e0 / r), 6) AS mrr FROM (
 SELECT o_custkey, o_orderstatus, o_orderkey, @rank{PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey} AS r, @rank{PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey} AS f FROM orders) AS x WHERE f = 1 AND o_orderstatus = 'F'""", "G11: one positive a query, its first")
sql_query("hit_rate", "SELECT p_brand, round(@if{p_size <= 25} / CAST(count(*) AS DOUBLE), 4) AS hit_rate FROM part GROUP BY p_brand", "Z30")
sql_query("prefix_hit", "SELECT p_type, @if{p_name LIKE 'hot%'} AS hits, count(*) AS n FROM part GROUP BY p_type", "Z33")
sql_query("lr_schedule", "SELECT epoch, CASE WHEN step <= 6 THEN step / 6e0 ELSE greatest(0e0, (total - step) / (total - 6e0)) END AS factor FROM (SELECT epoch, @rank{ORDER BY epoch} AS step, count(*) OVER () AS total FROM (" + EPOCHS + ") AS e) AS s", "M4: linear warm-up and decay")
sql_query("split_overlap", """SELECT 'ids' AS what, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) AS a
 UNION ALL SELECT 'pairs', count(*) FROM (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1) AS b""", "J5, U2")
sql_query("before_after_outcome", f"SELECT p_brand, p_partkey, r0, r1, CASE WHEN r0 = r1 THEN 'unchanged' WHEN r1 = 1 THEN 'fixed' WHEN r0 = 1 THEN 'regressed' WHEN r1 < r0 THEN 'improved' ELSE 'worsened' END AS outcome FROM ({RANKS}) AS r WHERE least(r0, r1) <= 10", "J13, D25, Z31")
sql_query("metadata_diff", "SELECT o.p_partkey, o.p_name AS old_name, n.p_name AS new_name FROM part o JOIN (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part) n ON o.p_partkey = n.p_partkey WHERE o.p_name IS DISTINCT FROM n.p_name", "J13, D29")
sql_query("metadata_corrections", "SELECT field, count(*) AS n FROM (SELECT CASE WHEN p_size % 5 = 0 THEN 'name' END AS field FROM part UNION ALL SELECT CASE WHEN p_type LIKE 'P%' THEN 'type' END FROM part UNION ALL SELECT CASE WHEN p_retailprice < 950 THEN 'price' END FROM part) AS c WHERE field IS NOT NULL GROUP BY field", "Z32")
sql_query("ab_decision", f"SELECT CASE WHEN better > worse AND regressions = 0 THEN 'KEEP' WHEN better > worse THEN 'REVIEW' ELSE 'REJECT' END AS decision, better, worse, regressions FROM (SELECT @if{{r1 < r0}} AS better, @if{{r1 > r0}} AS worse, @if{{r0 = 1 AND r1 > 1}} AS regressions FROM ({RANKS}) AS r) AS c", "Z29")
sql_query("score_pair_sample", f"SELECT p_brand, p_partkey, r0 FROM ({RANKS}) AS r WHERE r0 <= 3 OR r1 = 1", "Z26: keeps the first three and the positive")
sql_query("cross_domain_misses", "SELECT e.label AS expected, t.label AS found, count(*) AS n FROM embeddings e JOIN embeddings t ON t.vec_id = e.vec_id + 1 WHERE e.label <> t.label GROUP BY e.label, t.label", "Z25")


@query("vector_delta_stats", """WITH d AS (SELECT a.label, abs(CAST(unnest(a.embedding) AS DOUBLE) - CAST(unnest(b.embedding) AS DOUBLE)) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, count(*) AS n, round(sum(d), 6) AS total, round(max(d), 6) AS largest, count(*) FILTER (d > 0) AS nonzero FROM d GROUP BY label""")
def vector_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise differences of each vector and the next, added up where the arrays are."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    d = e.join(b, "vec_id").select("label", F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))).alias("d"))
    add = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    some = F.size(F.filter("d", lambda x: x > 0)).cast("long")
    return d.groupBy("label").agg(F.sum(F.size("d")).alias("n"), F.round(F.sum(add), 6).alias("total"), F.round(F.max(F.array_max("d")), 6).alias("largest"), F.sum(some).alias("nonzero"))
