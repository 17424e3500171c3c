"""Suites on the catalogue: orders are cases, four orders of their candidates are systems; the oracles read attributes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import constraints as C
from docsift.operators import suites as S
from docsift.session import checkpointed

from .catalogue import BASE, _scored
from .registry import query

SYSTEMS = ["initial", "gated", "constrained", "final"]
RANKS = f"""{BASE},
o AS (SELECT w.*, coalesce(compatibility = 'incompatible' OR material_state = 'CONTRADICTION' OR use_state = 'CONTRADICTION' OR excluded = 'CONTRADICTION' OR grade_state = 'CONTRADICTION' OR heat_state = 'CONTRADICTION', false) AS contradicts,
 row_number() OVER (PARTITION BY query_id ORDER BY rank) AS initial, row_number() OVER (PARTITION BY query_id ORDER BY compatibility = 'incompatible', rank) AS gated,
 row_number() OVER (PARTITION BY query_id ORDER BY least(constraint_score, 0) DESC, constraint_score DESC, rank) AS constrained,
 row_number() OVER (PARTITION BY query_id ORDER BY constraint_score < 0, 1.0::DOUBLE / (60 + rank) + constraint_score DESC, rank) AS final FROM w),
r AS (SELECT query_id, doc_id, compatibility, contradicts, system, place FROM (SELECT query_id, doc_id, compatibility, contradicts, initial, gated, constrained, final FROM o) UNPIVOT (place FOR system IN (initial, gated, constrained, final))),
cs AS (SELECT query_id, any_value(CASE WHEN x.grade IS NULL THEN 'plain' ELSE 'graded' END) AS suite, any_value(x.family) AS family FROM c GROUP BY query_id),
ex AS (SELECT query_id, arg_min(doc_id, rank) FILTER (compatibility = 'compatible') AS expected FROM w GROUP BY query_id),
e AS (SELECT r.system, r.query_id, min(place) FILTER (doc_id = expected) AS rank, bool_or(place = 1 AND compatibility = 'incompatible') AS cross_product, bool_or(place <= 5 AND contradicts) AS contradiction
 FROM r JOIN ex ON ex.query_id = r.query_id GROUP BY r.system, r.query_id)"""


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of all systems and the cases."""
    scored = checkpointed(_scored(spark, sf_dir).select("query_id", "doc_id", "rank", "q_family", "q_grade", "product", "q_product", "family", "constraint_score", "flags"))
    fit = C.compatibility(F.col("q_product"), F.col("product"), F.col("q_family"), F.col("family"))
    rows = scored.withColumn("compatibility", fit).withColumn("contradicts", F.exists("flags", lambda x: F.contains(x, F.lit("CONTRADICTION")))).withColumn("rrf_score", 1.0 / (60 + F.col("rank")))
    # The four orders are windows over one exchange by query; each candidate then is a row a system.
    ranked = C.final_order(C.order(C.gate(rows, F.col("compatibility"))))
    places = zip(SYSTEMS, (F.col("rank") - 1, F.col("gated_rank"), F.col("constraint_rank"), F.col("final_rank")), strict=True)
    systems = F.array(*(F.struct(F.lit(name).alias("system"), place.cast("long").alias("rank")) for name, place in places))
    out = ranked.select("query_id", "doc_id", "compatibility", "contradicts", F.inline(systems))
    cases = rows.groupBy("query_id").agg(F.any_value(F.when(F.col("q_grade").isNull(), "plain").otherwise("graded")).alias("suite"), F.any_value("q_family").alias("family"), F.min_by("doc_id", F.when(F.col("compatibility") == "compatible", F.col("rank"))).alias("expected"))
    return out, cases


@query("suite_evaluation", f"""WITH {RANKS} SELECT system, suite, family, count(*) AS cases, {", ".join(f"count(*) FILTER (rank <= {k}) AS hit{k}" for k in S.HITS)}, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall{k}" for k in S.RECALLS)},
 round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS found, count(*) FILTER (cross_product) AS cross_product_errors, count(*) FILTER (contradiction) AS contradictions,
 round(avg(CASE WHEN contradiction THEN 1.0::DOUBLE ELSE 0 END), 6) AS contradiction_rate, CASE WHEN grouping(suite) = 1 THEN 0 WHEN grouping(family) = 1 THEN 1 ELSE 2 END AS level
 FROM e JOIN cs USING (query_id) GROUP BY GROUPING SETS ((system), (system, suite), (system, suite, family))""")
def suite_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four systems, two suites and their families in one pass."""
    results, cases = _results(spark, sf_dir)
    return S.evaluate(S.case_rows(results, cases, SYSTEMS))


@query("presence_matrix", f"""WITH {RANKS} SELECT o.query_id, o.doc_id, {", ".join(f"CASE WHEN {s} <= 3 THEN {s} END AS {s}" for s in SYSTEMS)} FROM o JOIN ex ON ex.query_id = o.query_id AND ex.expected = o.doc_id""")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each system has the expected document, if among its first three."""
    results, cases = _results(spark, sf_dir)
    return S.presence(results, cases.where("expected is not null").select("query_id", F.col("expected").alias("doc_id")), SYSTEMS, 3)


@query("ab_preservation", f"""WITH {RANKS}, p AS (SELECT suite, query_id, min(rank) FILTER (system = 'initial') AS b, min(rank) FILTER (system = 'final') AS a FROM e JOIN cs USING (query_id) GROUP BY ALL),
g AS (SELECT suite, count(*) FILTER (a = 1 AND b IS DISTINCT FROM 1) AS fixed, count(*) FILTER (b = 1 AND a IS DISTINCT FROM 1) AS lost, count(*) FILTER (a = 1 AND b = 1) AS kept, count(*) FILTER (a IS NULL) AS missed,
 round(avg(coalesce(1.0::DOUBLE / a, 0)) - avg(coalesce(1.0::DOUBLE / b, 0)), 6) AS mrr_delta FROM p GROUP BY suite) SELECT *, mrr_delta > 0 AND lost = 0 AS keep FROM g""")
def ab_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the final order fixed and lost of the initial one, and whether it is kept."""
    results, cases = _results(spark, sf_dir)
    return S.preserved(S.case_rows(results, cases, SYSTEMS), "initial", "final")
