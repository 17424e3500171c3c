"""Checks inside the write: rows that break a rule stop the job that writes them, totals are observed by it, and only what passes is published.

Nothing is scanned for a check alone. Rules of rows raise within the write, so what they would let through is never committed. Totals are
known when the write ends: a dataset is its manifest, which is written last and only if the totals are as expected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as T


class CheckFailed(ValueError):
    """Totals that are not as expected; what was written is not published."""


def guarded(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """df; the first row of which a rule does not hold (null counts as not holding) stops the job, with the rule's name and the row's key."""
    for name, holds in rules.items():
        told = F.concat(F.lit(f"{name}: "), F.coalesce(key.cast("string"), F.lit("null")))
        df = df.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    return df


def without_leaks(pairs: DataFrame, frozen: DataFrame, query: str = "query", few: int = 100_000) -> DataFrame:
    """pairs; a query whose text a frozen set holds stops the job that reads them. frozen: text. Keys are met by an equi-join in that job."""
    keys = frozen.select(T.leakage_key(F.col("text")).alias("_frozen")).where(F.col("_frozen").isNotNull()).distinct()
    side = F.broadcast(keys) if keys.limit(few + 1).count() <= few else keys
    met = pairs.join(side, T.leakage_key(F.col(query)) == F.col("_frozen"), "left")
    return guarded(met, {"query leaks from a frozen set": F.col("_frozen").isNull()}, F.col(query)).drop("_frozen")


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], key: Column, totals: dict[str, Column], expected: dict[str, object]) -> dict[str, object]:
    """Writes df under path and publishes it if rules hold and the totals are as expected; tells the totals.

    totals: aggregates of what is written; expected: values that some of them must have, or functions that must be true of them.
    A write that fails leaves what was published before as it was.
    """
    seen, version = Observation(), uuid.uuid4().hex
    aggregates = [c.alias(n) for n, c in totals.items()]
    guarded(df, rules, key).observe(seen, *aggregates).write.parquet(f"{path}/{version}")
    told = {n: seen.get.get(n) for n in totals}
    wrong = [f"{n} is {told[n]}" + ("" if callable(want) else f", not {want}") for n, want in expected.items() if not (want(told[n]) if callable(want) else told[n] == want)]
    if wrong:
        raise CheckFailed("; ".join(wrong))
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return told


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """What was published last."""
    return spark.read.parquet(f"{path}/{spark.read.parquet(f'{path}/manifest').first().version}")
