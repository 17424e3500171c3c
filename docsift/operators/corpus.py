"""Audit, canonical records and keyed upserts as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import text as T

SHORT, LONG, MERGED = 80, 25_000, 5


def audit_issues(records: DataFrame, merged_pattern: str) -> DataFrame:
    """source_index, issue_type: one row for each rule a record breaks.

    records: source_index, code, key, title, scope, full_text, page_start, page_end.
    """
    present = {c: T.clean(F.col(c)) for c in ("code", "key", "title", "scope", "full_text")}
    length = sum((F.coalesce(F.char_length(present[c]), F.lit(0)) for c in ("title", "scope", "full_text")), F.lit(0))
    rules = [(f"missing_{c}", present[c].isNull()) for c in present]
    rules += [
        ("short_record", length < SHORT),
        ("long_record", length > LONG),
        ("possible_merge", (F.regexp_count(F.coalesce("full_text", F.lit("")), F.lit(merged_pattern)) >= MERGED) | F.contains(F.lower(F.coalesce("full_text", F.lit(""))), F.lit("merged"))),
        ("invalid_page_range", F.col("page_end") < F.col("page_start")),
    ]
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return records.select("source_index", F.explode(broken).alias("issue_type"))


def canonical(records: DataFrame, key: str, score: Column, index: str) -> DataFrame:
    """The best record of each key (score, then smallest index), how many there were, and whether they conflict.

    The best is a maximum over structs, so that a key with very many records is combined before the shuffle.
    """
    signature = F.xxhash64(F.coalesce(T.leakage_key(F.col("title")), F.lit("")), F.coalesce(T.leakage_key(F.col("full_text")), F.lit("")))
    return records.groupBy(key).agg(
        F.max(F.struct(score.alias("score"), (-F.col(index)).alias("i"))).alias("best"),
        F.count("*").alias("source_record_count"),
        (F.min(signature) != F.max(signature)).alias("conflicting"),
    ).select(key, (-F.col("best.i")).alias("source_index"), F.col("best.score").alias("quality_score"), "source_record_count", "conflicting")


def upsert(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The merged table with the column change: inserted, updated, unchanged or kept.

    New rows overwrite every value, NULLs too; a row is unchanged if all its values are (null-safely) equal.
    """
    o = old.select(key, F.struct(*values).alias("o"))
    n = new.select(key, F.struct(*values).alias("n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("updated")
    return both.select(key, change.alias("change"), F.coalesce("n", "o").alias("x")).select(key, "change", "x.*")


def allied(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours of each node; nodes without any keep one row of NULLs (GR1)."""
    both = edges.select("src", "dst", "relation").union(edges.select(F.col("dst"), F.col("src"), F.col("relation"))).distinct()
    return nodes.join(both, nodes["id"] == both["src"], "left").select("id", "relation", F.col("dst").alias("neighbor"))


def graph_merge(rows: DataFrame, order: str) -> DataFrame:
    """One edge for each (src, relation, dst), the last evidence wins; relation types become upper snake case (GR2)."""
    relation = F.upper(F.regexp_replace(F.trim("relation"), "[^A-Za-z0-9]+", "_"))
    named = rows.withColumn("relation", relation).where("relation <> ''")
    return named.groupBy("src", "relation", "dst").agg(F.max_by("evidence", order).alias("evidence"))


def ordered_first(matches: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value in table order for each key: ordered cascades as data."""
    return matches.groupBy(key).agg(F.min_by(value, order).alias(value))


def round_robin(rows: DataFrame, bucket: list[str], order: list[str], n: int) -> DataFrame:
    """One row of each bucket in turn until there are n."""
    turn = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return rows.withColumn("turn", turn.cast("long")).orderBy("turn", *bucket).limit(n)
