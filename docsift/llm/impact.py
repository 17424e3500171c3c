"""Ranked lexical search: impact-ordered postings, score at a time.

One pass over the documents counts, for each, all its terms and those that a query has (the forward rows). From the sums of these
rows come the weights of the terms and the impact of every posting. The forward rows are then searched in shards of a bounded
number of postings. A shard groups the postings of each term by exact impact, and a query takes groups in the order of what they add to
a score, whole groups at a time and from the highest. It stops once the next group of every term together cannot lift a document
that is not among the candidates to the k-th score reached; the scores of the candidates are then completed from their rows. Each
shard's best k meet in one window with a limit before its shuffle. No term, document or query is a key of a shuffle of postings, so
frequent words need no special care; queries are broadcast in blocks of a bounded number of terms, each block one scan.

Defined results: null and empty texts have no terms, and an item without terms finds nothing; very long texts are folded and counted
in pieces; of equal scores smaller doc_ids come first, null ones last; rows that repeat a doc_id are ranked one by one; rows that
repeat an item_id (null too) are one item with the terms of all of them; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Results an item.
K = 20
#: A shard's postings, at least (one batch of rows more at most): some 40 bytes each in a worker.
SHARD = 1 << 20
#: Terms (of one item each) in a block of queries.
BLOCK_TERMS = 200_000
#: Characters of a folded text that are split at once.
PIECE = 1 << 20
#: A query stops if so many times k candidates are left: their scores are completed, so this bounds work and not results.
COMPLETED = 4

#: ASCII letters in lower case, digits and bytes of other characters stay; the rest parts terms.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded number at a time."""
    if not text:
        return
    folded = text.translate(FOLD)
    begin = 0
    while begin < len(folded):
        end = folded.find(b" ", begin + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


def _bytes(c: pa.Array) -> list[bytes | None]:
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


def _count(text: bytes | None, ids: dict[bytes, int]) -> tuple[int, Counter]:
    n, found = 0, Counter()
    for some in terms(text):
        n += len(some)
        found.update(map(ids.get, some))
    found.pop(None, None)
    return n, found


def query_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[dict[int | None, Counter]]:
    """Items with the times of each of their terms, a bounded number of terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            rows = [(i, x, n) for i, t in zip(b.column("item_id").to_pylist(), _bytes(b.column("text")), strict=True) for x, n in sum(map(Counter, terms(t)), Counter()).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "term", "n"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(run, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    block: dict[int | None, Counter] = {}
    size = 0
    for row in found.orderBy("item_id", "term").toLocalIterator():
        if row.item_id not in block and size >= most:
            yield block
            block, size = {}, 0
        block.setdefault(row.item_id, Counter())[bytes(row.term)] = row.n
        size += 1
    if block:
        yield block


def forward(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (those in ids, by number), times; only documents with terms."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ids)  # BLOCK_TERMS and the terms of one item at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in common.slices(batches, "text"):
            rows = [(i, n, list(c), list(c.values())) for i, t in zip(b.column("doc_id").to_pylist(), _bytes(b.column("text")), strict=True) for n, c in [_count(t, known)] if n]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n", "terms", "times"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """Documents' postings, those of a term by descending impact; and the same by document."""

    def __init__(self, lengths: np.ndarray, n: np.ndarray, terms_: np.ndarray, times: np.ndarray, vocabulary: int, documents: int, all_terms: int):
        m = 100 - 25 + (25 * n * documents) // all_terms
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.repeat(np.arange(len(n)), lengths)
        impact = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
        self.terms, self.impacts, self.size = terms_, impact, len(n)
        order = np.lexsort((-impact, terms_))
        self.doc, self.falling = doc[order].astype(np.int32), -impact[order]
        self.starts = np.searchsorted(terms_[order], np.arange(vocabulary + 1))

    def top(self, ids: np.ndarray, factors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of documents that may be among the k best, all that are among them included, and their whole scores."""
        at, end = self.starts[ids].copy(), self.starts[ids + 1]
        keep = (end > at) & (factors > 0)
        ids, factors, at, end = ids[keep], factors[keep], at[keep], end[keep]
        score = np.zeros(self.size, np.int64)
        while True:
            more = at < end
            adds = np.where(more, -self.falling[np.where(more, at, 0)] * factors, 0) if len(ids) else np.zeros(0, np.int64)
            rest = int(adds.sum())
            kth = int(np.partition(score, -k)[-k]) if self.size > k else 0
            # Whatever has not reached kth - rest can come to less than kth at most, and k documents have kth already.
            candidates = np.flatnonzero(score >= max(kth - rest, 1))
            if rest == 0 or kth > rest and len(candidates) <= COMPLETED * k:
                break
            level = -(-int(adds.max()) * 3 // 4)
            for j in np.flatnonzero(adds >= level):  # whole groups of equal impact, down to the level
                to = at[j] + np.searchsorted(self.falling[at[j] : end[j]], -level // factors[j], side="right")
                score[self.doc[at[j] : to]] -= self.falling[at[j] : to] * factors[j]
                at[j] = to
        if rest:
            dense = np.zeros(len(self.starts), np.int64)
            dense[ids] = factors
            for d in candidates:
                own = slice(self.first[d], self.first[d + 1])
                score[d] = dense[self.terms[own]] @ self.impacts[own]
        return candidates, score[candidates]


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item."""
    spark = docs.sparkSession
    schema = "item_id long, doc_id long, score long"
    out = None
    for block in query_blocks(items, block_terms):
        ids = {x: i for i, x in enumerate(sorted({x for c in block.values() for x in c}))}
        rows = common.cut(forward(docs, ids))
        total = rows.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not total.documents:
            continue
        df = {r.t: r["count"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator()}  # a row for each term of the block
        w = np.array([weight(total.documents, df.get(i, 0)) for i in range(len(ids))], np.int64)
        queries = [(item, (own := np.array([ids[x] for x in c], np.int64)), w[own] * np.array(list(c.values()), np.int64)) for item, c in block.items()]
        shared = spark.sparkContext.broadcast((queries, len(ids), total.documents, total.terms))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, vocabulary, documents, all_terms = shared.value

            def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                doc_ids = [i for b in held for i in b.column("doc_id").to_pylist()]
                order = np.array([(1 << 63) - 1 if i is None else i for i in doc_ids], np.int64)
                part = Shard(
                    np.concatenate([b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for b in held]),
                    np.concatenate([b.column("n").to_numpy() for b in held]), np.concatenate([_flat(b, "terms") for b in held]), np.concatenate([_flat(b, "times") for b in held]),
                    vocabulary, documents, all_terms,
                )
                for item, own, factors in queries:
                    places, scores = part.top(own, factors, k)
                    first = np.lexsort((order[places], -scores))[:k]
                    found = [doc_ids[p] for p in places[first]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.int64()), pa.array(scores[first], pa.int64())], names=["item_id", "doc_id", "score"])

            held, size = [], 0
            for b in batches:
                held.append(b)
                size += len(b.column("terms").flatten())
                if size >= shard:
                    yield from best(held)
                    held, size = [], 0
            if size:
                yield from best(held)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(c="text")} AS t FROM documents),
docs AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
queries AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format(c="text")}) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM queries) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
impacts AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * (SELECT docs FROM total)) // (SELECT terms FROM total))) AS impact FROM tf JOIN docs USING (r)),
scores AS (SELECT item_id, r, sum(times * w * impact)::BIGINT AS score FROM queries JOIN w USING (term) JOIN impacts USING (term) GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores JOIN docs USING (r) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= {K}"""
