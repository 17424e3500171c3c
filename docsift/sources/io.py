"""Readers and writers: JSON lists and envelopes, JSON lines, CSV with a fixed header, pairs under contract, canonical datasets.

Readers take a schema and never infer it over the data. Paths go to Spark as they are, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "is_code string, is_code_norm string, title string, scope string, full_text string, revision string, page_start string, page_end string"
PAIR = "query_id string, query string, document string, label int, standard_code string, pair_type string"


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of a JSON list, or of {"records": [...]}, with source_index from 1; an error if a file is neither."""
    text = spark.read.text(path, wholetext=True)
    bad = text.where(~F.rlike(F.trim("value"), F.lit(r"(?s)^\s*(\[.*\]|\{.*\"records\"\s*:\s*\[.*\].*\})\s*$")))
    if bad.limit(1).count():
        raise ValueError(f"{path}: neither a list nor an object with records")
    listed = F.from_json("value", F.lit(f"array<struct<{_nested(schema)}>>"))
    held = F.from_json("value", F.lit(f"struct<records: array<struct<{_nested(schema)}>>>"))["records"]
    rows = text.select(F.posexplode(F.when(F.rlike("value", F.lit(r"^\s*\[")), listed).otherwise(held)).alias("i", "r"))
    typed = rows.select((F.col("i") + 1).cast("long").alias("source_index"), "r.*")
    for c in ("page_start", "page_end"):
        if c in typed.columns:
            typed = typed.withColumn(c, F.expr(f"try_cast({c} AS INT)"))
    return typed


def _nested(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def write_dataset(records: DataFrame, path: str, name: str, note: str = "") -> int:
    """Records as Parquet and a manifest (dataset_name, record_count, source_note) beside them."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    n = records.sparkSession.read.parquet(f"{path}/records").count()
    manifest = json.dumps({"dataset_name": name, "record_count": n, "source_note": note})
    records.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return n


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The records and the manifest; an error if they do not agree on the count."""
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    records = spark.read.parquet(f"{path}/records")
    if (n := records.count()) != manifest["record_count"]:
        raise ValueError(f"{path}: {n} records, the manifest has {manifest['record_count']}")
    return records, manifest


def read_jsonl(spark: SparkSession, path: str, schema: str, comments: bool = False, strict: bool = False) -> DataFrame:
    """S3: JSON lines; blank lines are skipped, with comments also those that begin with #; strict fails on a bad line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.startswith(F.ltrim("value"), F.lit("#")))
    parsed = lines.select(F.from_json("value", F.lit(schema), {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; NULLs are written."""
    row = F.struct(*(F.col(c) for c in sorted(df.columns)))
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, header: list[str], joiner: str = "; ") -> None:
    """The columns of the header, arrays joined."""
    cols = [F.array_join(c, joiner).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in header]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def read_csv_by_key(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """One row a key, the last by order."""
    rows = spark.read.csv(path, schema=schema, header=True, escape='"')
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training pairs that keep the contract, and those that do not, with the rule they break."""
    rows = read_jsonl(spark, path, PAIR)
    blank = F.coalesce(F.trim("query"), F.lit("")) == ""
    rule = (
        F.when(blank | (F.coalesce(F.trim("document"), F.lit("")) == ""), "blank_text")
        .when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "label")
        .when((F.col("label") == 1) != (F.col("pair_type") == "positive"), "type_mismatch")
        .when((F.col("label") == 0) & (F.col("pair_type") != "hard_negative"), "type_mismatch")
    )
    told = rows.withColumn("rule", rule)
    return told.where("rule is null").drop("rule"), told.where("rule is not null")
