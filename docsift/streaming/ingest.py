"""Incremental ingest: an extension, not a feature of the reference. New JSON records are upserted batch by batch.

The table is a chain of versions, each written whole beside the last and named by its batch, so that a batch which runs
again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docsift.operators import corpus


def version(path: str, batch: int) -> str:
    return f"{path}/v{batch:012d}"


def latest(spark: SparkSession, path: str) -> str | None:
    """The newest complete version."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return f"{path}/{max(done)}" if done else None


def ingest(spark: SparkSession, source: str, schema: str, key: str, values: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over the JSON files in source that merges each batch into the table; it ends when all are read."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.where(f"{key} is not null").dropDuplicates([key]).select(key, *values)
        before = [v for v in [latest(spark, table)] if v and v < version(table, number)]
        old = spark.read.parquet(before[0]).select(key, *values) if before else spark.createDataFrame([], new.schema)
        corpus.upsert(old, new, key, values).write.mode("overwrite").parquet(version(table, number))

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
