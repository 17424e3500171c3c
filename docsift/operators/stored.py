"""A stored BM25 index: postings on disk in blocks with bounds, dealt by term; batches are added, and searches read what they need.

Blocks hold postings of one term, one frequency and documents of about one length, so that the bound of a block is close to what its
postings are worth at any later average length. They are dealt into folders by a hash of the term: a search reads the folders of its
terms alone, and the document ids only of blocks that may matter. Search is MaxScore: the rarest terms of a query give a score
that k documents reach; terms that together stay under it need no list of their own; blocks that with all other terms at their best
stay under it are skipped; the candidates that are left are scored with all terms, so the result is that of `Bm25Index.search`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from docsift.functions import text as T
from docsift.operators import retrieval as R
from docsift.session import checkpointed

#: Folders of postings, and postings of a block at most.
PARTS, BLOCK = 64, 128
#: Documents, times k, whose whole scores tell what k documents reach; and pairs of query and document that are broadcast.
SEEDS, PAIRS = 10, 500_000
#: Rounding of sums, by which bounds are wider.
SLACK = 2e-6


def _part(tok: Column) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(PARTS)).cast("int")


def _worth(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _counted(some: DataFrame) -> DataFrame:
    """doc_id, dl, tok, tf of documents of one row each (doc_id, toks), counted where they lie."""
    schema = StructType([some.schema["doc_id"], StructField("dl", LongType()), StructField("tok", StringType()), StructField("tf", LongType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks, size = b.column("toks"), b.column("toks").value_lengths().to_numpy()
            words = toks.flatten().dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(b.num_rows), size)
            pair, tf = np.unique(row * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(pair, len(words.dictionary))
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(size[row], pa.int64()), words.dictionary.take(pa.array(word)), pa.array(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return some.mapInArrow(count, schema)


def _cut_blocks(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (part, tok, tf, dl, doc_id) in runs of BLOCK at most, of one term, one frequency and about one length."""
    for b in batches:
        if not b.num_rows:
            continue
        tok, tf, dl = b.column("tok").dictionary_encode().indices.to_numpy(), b.column("tf").to_numpy(), b.column("dl").to_numpy()
        level = np.floor(np.log2(dl) * 4)
        new = np.ones(b.num_rows, bool)
        new[1:] = (tok[1:] != tok[:-1]) | (tf[1:] != tf[:-1]) | (level[1:] != level[:-1])
        place, cell = np.arange(b.num_rows), np.flatnonzero(new)
        new |= (place - np.repeat(cell, np.diff(np.append(cell, b.num_rows)))) % BLOCK == 0
        at = np.flatnonzero(new)
        first, ends = pa.array(at), np.append(at, b.num_rows)
        each = pa.StructArray.from_arrays([b.column("doc_id"), b.column("dl")], names=["doc_id", "dl"])
        docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
        columns = [*(b.column(c).take(first) for c in ("part", "tok", "tf")), pa.array(np.diff(ends), pa.int64()), b.column("dl").take(first), docs]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _counted_few(rows: DataFrame, most: int) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts what is made of these rows, if they are at most so many."""
    return F.broadcast if rows.limit(most + 1).count() <= most else lambda df: df


class StoredIndex:
    """An index in a folder of any store that Spark reads; an empty or missing folder is an empty index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def add(self, docs: DataFrame, doc_id: str, text: str) -> int:
        """Adds a batch and tells its documents. A document that is there already is an error: the batch is not added.

        Null texts count as empty ones; of rows that repeat a doc_id within a batch the texts go together; rows without doc_id are left out.
        """
        some = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")).alias("toks"))
        counted = checkpointed(some.groupBy("doc_id").agg(F.sum(F.size("toks")).alias("dl"), F.count("*").alias("rows")))
        lengths = counted.select("doc_id", "dl")
        before = self._read("docs")
        if before is not None and not before.select("doc_id").join(lengths, "doc_id", "left_semi").isEmpty():
            raise ValueError(f"{self.path}: documents of the batch are in the index")
        again = counted.where("rows > 1")
        if again.isEmpty():
            postings = _counted(some)
        else:  # documents of several rows are summed by a shuffle, all others where they lie
            twice = some.join(again.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("toks").alias("tok"))
            summed = twice.groupBy("doc_id", "tok").agg(F.count("*").alias("tf")).join(again.select("doc_id", "dl"), "doc_id")
            postings = _counted(some.join(again, "doc_id", "left_anti")).unionByName(summed)
        self._store(postings)
        lengths.write.mode("append").parquet(f"{self.path}/docs")
        return lengths.count()

    def _store(self, postings: DataFrame) -> None:
        """Blocks of postings (doc_id, dl, tok, tf): one shuffle, by ranges, that deals a frequent term over tasks by length and document."""
        postings = postings.select(_part(F.col("tok")).alias("part"), "tok", "tf", "dl", "doc_id")
        order = ["part", "tok", "tf", "dl", "doc_id"]
        kind = postings.schema["doc_id"].dataType
        docs = ArrayType(StructType([StructField("doc_id", kind), StructField("dl", LongType())]))
        schema = StructType([StructField("part", IntegerType()), StructField("tok", StringType()), StructField("tf", LongType()), StructField("n", LongType()), StructField("min_dl", LongType()), StructField("docs", docs)])
        blocks = postings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_cut_blocks, to_arrow_schema(schema)), schema)
        blocks.write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")

    def merge(self, into: str) -> StoredIndex:
        """The same postings in full blocks, after many small batches, in another folder."""
        new = StoredIndex(self.spark, into)
        blocks, docs = self._read("postings"), self._read("docs")
        if blocks is None or docs is None:
            return new
        new._store(blocks.select("tok", "tf", F.explode("docs").alias("d")).select("d.doc_id", "d.dl", "tok", "tf"))
        docs.write.parquet(f"{new.path}/docs")
        return new

    def blocks(self, terms: DataFrame) -> DataFrame | None:
        """The blocks of these terms (column tok), from their folders alone."""
        found = self._read("postings")
        if found is None:
            return None
        parts = sorted(r.p for r in terms.select(_part(F.col("tok")).alias("p")).distinct().collect())  # PARTS at most
        few = terms.limit(R.BROADCAST_TERMS + 1).count() <= R.BROADCAST_TERMS
        return found.where(F.col("part").isin(parts)).join(F.broadcast(terms) if few else terms, "tok", "left_semi")

    def search(self, queries: DataFrame, query_id: str, text: str, k: int = R.TOP, k1: float = R.K1, b: float = R.B) -> DataFrame:
        """query_id, doc_id, score, rank; as Bm25Index.search over all batches."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(text))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
        blocks, docs = self.blocks(asked.select("tok").distinct()), self._read("docs")
        if blocks is None or docs is None:
            return self.spark.createDataFrame([], f"query_id {queries.schema[query_id].dataType.simpleString()}, doc_id long, score double, rank long")
        stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        n, avgdl = F.lit(stats.n), F.lit(stats.avgdl)
        bound, worth = (_worth(F.col("tf"), F.col(c), avgdl, k1, b) for c in ("min_dl", "dl"))
        # Bounds and frequencies come from columns without the documents.
        of_term = blocks.groupBy("tok").agg(F.sum("n").alias("df"), F.max(bound).alias("top"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = asked.join(of_term, "tok").withColumn("w", F.col("qtf") * idf).withColumn("most", F.col("w") * F.col("top"))
        by_query = Window.partitionBy("query_id")  # the terms of a query
        rarest = by_query.orderBy("df", "tok")
        terms = terms.withColumn("before", F.sum("df").over(rarest) - F.col("df")).withColumn("all", F.sum("most").over(by_query)).withColumn("upto", F.sum("most").over(by_query.orderBy("most", "tok")))
        terms = checkpointed(terms)
        few = _counted_few(terms, R.BROADCAST_TERMS)

        def opened(of: DataFrame, where: Column | None = None) -> DataFrame:
            """query_id, doc_id and s, the worth of a posting, of the blocks of these terms (that hold the condition)."""
            met = blocks.join(few(of), "tok")
            each = (met if where is None else met.where(where)).select(*of.columns, "tf", F.explode("docs").alias("d"))
            return each.select(*(c for c in of.columns if c != "tok"), F.col("d.doc_id").alias("doc_id"), F.col("tf"), F.col("d.dl").alias("dl")).withColumn("s", F.col("w") * worth)

        def whole(pairs: DataFrame) -> DataFrame:
            """The scores of these pairs of query_id and doc_id, by all terms."""
            pairs = checkpointed(pairs)
            kept = _counted_few(pairs, PAIRS)(pairs)
            return opened(terms.select("query_id", "tok", "w")).join(kept, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))

        # What k documents reach: of those that the rarest terms put first, the k-th best by all terms.
        first = opened(terms.where(F.col("before") < k).select("query_id", "tok", "w")).groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))
        seeds = R.top_k(first, ["query_id"], [F.desc("s"), F.asc("doc_id")], SEEDS * k).select("query_id", "doc_id")
        reached = R.top_k(whole(seeds), ["query_id"], [F.desc("s"), F.asc("doc_id")], k).where(F.col("rank") == k).select("query_id", (F.col("s") - SLACK).alias("reached"))
        bounds = checkpointed(terms.join(reached, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0))))
        needed = bounds.where(F.col("upto") >= F.col("reached")).select("query_id", "tok", "w", "reached", (F.col("all") - F.col("most")).alias("others"))
        rest = bounds.groupBy("query_id").agg(F.first("reached").alias("reached"), F.coalesce(F.max(F.when(F.col("upto") < F.col("reached"), F.col("upto"))), F.lit(0.0)).alias("rest"))
        # A document that reaches it has no posting in a block that is skipped, so its sum over needed terms is whole.
        sums = opened(needed, F.col("w") * bound + F.col("others") >= F.col("reached")).groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))
        candidates = sums.join(few(rest), "query_id").where(F.col("s") + F.col("rest") >= F.col("reached") - SLACK).select("query_id", "doc_id")
        scored = whole(candidates).select("query_id", "doc_id", F.round("s", 6).alias("score"))
        return R.top_k(scored.where("score > 0"), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
