"""Exact deduplication over an extendible-hash index in shared files, with DataFrame functions alone.

The key of a text is a 64-bit hash. The directory begins as one bucket; while a bucket holds more keys than CAPACITY it is split by
one more leading bit of the key, and the directory doubles where the split bucket used all its bits. The rounds run over counts of
key prefixes, not over the keys. The directory has a slot for each prefix of its depth, so a key finds its bucket by an equi-join.

The index has one entry for each different text: bucket, key, its place in the key's chain, the largest doc_id and the number of rows.
Copies are summed by key and bytes before they reach the task that owns their bucket, so a group of copies is a few rows whatever its
size; the owners, each with a range of keys, chain texts that share a key. A key that only one row has needs no bytes.
Index and directory are Parquet in the cluster's shared folder. Rows find their entry by key, and by bytes where a chain is longer than one.

Defined results: null counts as the empty text, and both are equal; without a doc_id a row comes last (its group keeps a row without
one if no row has one); of rows that repeat doc_id and text one stays; very long texts are compared whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Keys of a bucket.
CAPACITY = 8_192
#: Leading bits more than one for each full bucket, by which keys are counted first.
SPARE_BITS = 6
#: Keys, and slots of the directory, that are broadcast at most.
BROADCAST_KEYS = 500_000


def prefix(key: Column, bits: int) -> Column:
    """The leading bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """slot, bucket (the first of its slots), local_depth; and the directory's depth. keys: a row for each, column key."""
    bits = min(64, math.ceil(math.log2(max(1, keys.count() / capacity))) + SPARE_BITS)
    left = common.cut(keys.groupBy(prefix(F.col("key"), bits).alias("p")).agg(F.count("*").alias("n")), files=1)
    done, depth = [], 0
    while True:
        at = F.shiftrightunsigned("p", bits - depth).alias("b")
        sums = left.groupBy(at).agg(F.sum("n").alias("n"))
        full = common.cut(sums.where((F.col("n") > capacity) & F.lit(depth < 64)).select("b"), files=1)
        done.append(sums.where((F.col("n") <= capacity) | F.lit(depth >= 64)).select("b", F.lit(depth).alias("local_depth")))
        if not full.limit(1).count():
            break
        left = left.join(_few(full), at == F.col("b"), "left_semi")
        depth += 1
        if depth > bits:  # prefixes of this length are too full: count the keys of these by longer ones
            bits = min(64, bits + 8)
            inside = keys.join(_few(full), prefix(F.col("key"), depth - 1) == F.col("b"), "left_semi")
            left = common.cut(inside.groupBy(prefix(F.col("key"), bits).alias("p")).agg(F.count("*").alias("n")), files=1)
    slots = None
    for x in done:
        free = F.lit(depth) - F.col("local_depth")
        own = F.call_function("shiftleft", F.lit(1).cast("long"), free)
        part = x.select(F.explode(F.sequence(F.lit(0).cast("long"), own - 1)).alias("i"), F.col("b"), "local_depth", own.alias("own"))
        part = part.select((F.col("b") * F.col("own") + F.col("i")).alias("slot"), (F.col("b") * F.col("own")).alias("bucket"), "local_depth")
        slots = part if slots is None else slots.union(part)
    return common.cut(slots, files=common.FEWEST_FILES), depth


def index(docs: DataFrame, keyed: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """bucket, key, chain (from 1), length (of the chain), text (if that is over 1), keep_id, group_size: an entry for each different text.

    keyed: a row for each row of docs, doc_id and key; written, since it is read more than once.
    """
    keys = common.cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")))
    slots, depth = directory(keys, capacity)
    again = keys.where("n > 1").select("key")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(text).alias("key"), text.alias("text"))
    if again.count() <= BROADCAST_KEYS:  # else all texts are summed, with the same result
        texts = texts.join(F.broadcast(again), "key", "left_semi")
        alone = keys.where("n = 1").select("key", F.lit(None).cast("string").alias("text"), F.col("last").alias("keep_id"), F.col("n").alias("group_size"))
    else:
        alone = None
    entries = texts.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = entries if alone is None else entries.unionByName(alone)
    placed = entries.join(_few(slots.select("slot", "bucket")), prefix(F.col("key"), depth) == F.col("slot"))
    owned = placed.repartitionByRange("bucket")  # an owner has whole buckets; two partitions never share one
    chain = Window.partitionBy("bucket", "key")
    length = F.count("*").over(chain)
    found = owned.select("bucket", "key", F.row_number().over(chain.orderBy("text")).alias("chain"), length.alias("length"), F.when(length > 1, F.col("text")).alias("text"), "keep_id", "group_size")
    return common.cut(found, old=[keys, slots])


def exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: a row for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keyed = common.cut(rows)
    entries = index(docs, keyed.select("doc_id", "key"), key, capacity)
    chained = entries.where("length > 1").select("key").distinct()
    if chained.limit(1).count():  # rows of these keys bring their texts
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
        ours = keyed.join(_few(chained), "key", "left_anti").withColumn("text", F.lit(None).cast("string")).unionByName(whole.join(_few(chained), "key", "left_semi"))
    else:
        ours = keyed.withColumn("text", F.lit(None).cast("string"))
    ours = ours.groupBy("doc_id", "key", "digest", "text").agg(F.count("*").alias("n"))  # rows that repeat doc_id and text
    e = entries.select(F.col("key").alias("k"), F.col("text").alias("t"), "keep_id", "group_size", "bucket")
    met = ours.join(e, (F.col("key") == F.col("k")) & F.col("text").eqNullSafe(F.col("t")))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = met.select("doc_id", "keep_id", "group_size", first.alias("first"), "digest", "bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("bucket")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
