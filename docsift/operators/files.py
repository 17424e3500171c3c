"""Digests of stored files as a tree: chunks, files, store; two stores are compared by their digests, without sending them.

Each store is digested where it can be read, and its digests are a small table that may be kept beside it. Stores are equal if their
roots are; else files whose digests differ are told, with the first chunk that does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a chunk.
CHUNK = 1 << 20


def digests(spark: SparkSession, path: str, chunk: int = CHUNK, glob: str | None = None) -> DataFrame:
    """file (below path), length, modified, chunk (from 0), digest of every file below path; Spark passes over empty files.

    It reads a file as one value, so files are of 2 GB at most, and a task holds one at a time; its chunks are digested in place.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + r"\Q" + "/" + path.split(":", 1)[-1].strip("/") + r"\E/?", "")
    count = F.ceil(F.col("length") / chunk)
    each = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.sha2(F.substring("content", (i * chunk + 1).cast("int"), F.lit(chunk)), 256))
    told = files.select(below.alias("file"), "length", F.col("modificationTime").alias("modified"), each.alias("d"))
    return told.select("file", "length", "modified", F.posexplode("d").alias("chunk", "digest"))


def of_files(chunks: DataFrame) -> DataFrame:
    """file, length, chunks, digest: of a file the digest of its chunks' digests in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"]), "")  # 64 characters a chunk
    return chunks.groupBy("file").agg(F.first("length").alias("length"), F.count("digest").alias("chunks"), F.sha2(listed, 256).alias("digest"))


def root(files: DataFrame) -> str:
    """The digest of a store, by the sums of its files' digests, so that no task lists all files; the same for the same files in any order."""
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x00", "file", "digest"), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    sums = files.agg(F.count("*").alias("n"), *(part(i).alias(f"s{i}") for i in range(8))).first()
    return "-".join(str(x or 0) for x in sums)


def compare(a: DataFrame, b: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file, state (equal, differs, only_a, only_b), first_chunk and at (its byte) where they differ. a, b: of digests(), of the same chunk size."""
    one = of_files(a).select("file", F.col("digest").alias("da"), F.lit(True).alias("in_a"))
    two = of_files(b).select("file", F.col("digest").alias("db"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(F.col("da") == F.col("db"), "equal").otherwise("differs")
    files = one.join(two, "file", "full_outer").select("file", state.alias("state"))
    unlike = files.where("state = 'differs'").select("file")
    # Only chunks of files that differ meet.
    left = a.join(unlike, "file", "left_semi").select("file", "chunk", F.col("digest").alias("x"))
    right = b.join(unlike, "file", "left_semi").select("file", "chunk", F.col("digest").alias("y"))
    first = left.join(right, ["file", "chunk"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("file").agg(F.min("chunk").alias("first_chunk"))
    return files.join(first, "file", "left").withColumn("at", F.col("first_chunk").cast("long") * chunk)
