"""Hard negatives over a whole catalogue: the k most similar sets of each category, by a threshold that rises.

Documents stay where they lie and are indexed in shards of a bounded number of words, word to documents. A query takes its words from
the rarest on. A document that holds none of the first words of a query shares the rest at most, so its similarity is at most the part of
the query's words that are left; once the k-th best of each category is better than that, nothing unseen can come in. What one
shard finds raises the threshold for the next of the same task. Documents alike in all that is compared are one class, of which only the
first by doc_id can be among the best; queries alike are searched once, and what is found is dealt to each of them. Queries are broadcast in blocks of a bounded number of words, each a
pass over the documents; only the best of each task are shuffled, so no word, product or family is a key of anything large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import checkpointed

# What a negative of each category is worth beyond its similarity, and how many of each are taken first; from
# which similarity of a field a document is a close variant.
BONUS = {"same_product": 0.30, "close_variant": 0.18, "trap": 0.05}
QUOTA = {"same_product": 2, "close_variant": 1, "trap": 1}
CLOSE = 0.35
#: Words of a shard of documents, and of a block of queries.
SHARD_WORDS, BLOCK_WORDS = 1 << 20, 500_000
#: Scores are compared as whole millionths.
MILLION = 1_000_000


def _millionths(x: np.ndarray | float) -> np.ndarray:
    return np.floor(np.asarray(x) * MILLION + 0.5).astype(np.int64)


class _Sets:
    """Rows of distinct words as numbers, in one array with offsets."""

    def __init__(self, column: pa.Array):
        flat = column.flatten().dictionary_encode()
        self.ids = {w: i for i, w in enumerate(flat.dictionary.to_pylist())}
        words = flat.indices.fill_null(len(self.ids)).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (len(self.ids) + 1) + words)  # a word counts once a row
        row, self.words = np.divmod(key, len(self.ids) + 1)
        self.row = row
        self.size = np.bincount(row, minlength=len(sizes))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def known(self, words: list[str]) -> np.ndarray:
        return np.array([i for w in words if (i := self.ids.get(w)) is not None], np.int64)

    def overlap(self, member: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many members each row has."""
        sizes = self.size[rows]
        at = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=member[self.words[at]], minlength=len(rows)).astype(np.int64)


def _codes(column: pa.Array) -> tuple[np.ndarray, dict[str, int]]:
    d = column.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), {v: i for i, v in enumerate(d.dictionary.to_pylist())}


class Shard:
    def __init__(self, table: pa.Table, near: list[str]):
        t = table.combine_chunks()
        whole = lambda n: t.column(n).chunk(0) if t.num_rows else pa.array([], t.schema.field(n).type)
        self.ids = whole("doc_id").to_pylist()
        self.place = np.empty(len(self.ids), np.int64)
        self.place[sorted(range(len(self.ids)), key=self.ids.__getitem__)] = np.arange(len(self.ids))
        self.sets, self.near = _Sets(whole("toks")), [_Sets(whole(n)) for n in near]
        self.product, self.family = _codes(whole("product")), _codes(whole("family"))
        order = np.argsort(self.sets.words, kind="stable")
        self.by_word = self.sets.row[order]
        self.starts = np.searchsorted(self.sets.words[order], np.arange(len(self.sets.ids) + 2))

    def _categories(self, query: tuple, rows: np.ndarray) -> np.ndarray:
        _, _, product, family, near, _ = query
        same = np.zeros(len(rows), bool)
        for (codes, ids), value in ((self.product, product), (self.family, family)):
            if value is not None and value in ids:
                same |= codes[rows] == ids[value]
        close = np.zeros(len(rows), bool)
        for sets, words in zip(self.near, near, strict=True):
            if words:
                member = np.zeros(len(sets.ids) + 1, bool)
                member[sets.known(words)] = True
                both = sets.overlap(member, rows)
                close |= both >= CLOSE * (sets.size[rows] + len(words) - both) - 1e-12
        return np.where(same, 0, np.where(close, 1, 2))

    def search(self, query: tuple, best: list[list[tuple]], most: int) -> int:
        """Improves best (of each category: the first by score and doc_id); tells how many documents were looked at."""
        own, words = query[1], query[5]
        known = self.sets.known(words)
        seen = np.zeros(len(self.ids), bool)
        member = np.zeros(len(self.sets.ids) + 1, bool)
        member[known] = True
        worth = list(BONUS.values())
        looked = 0

        def settled(bound: float) -> bool:
            return all(len(b) == most and -b[-1][0] > int(_millionths(bound + w)) for b, w in zip(best, worth, strict=True))

        def look(rows: np.ndarray) -> None:
            nonlocal looked
            looked += len(rows)
            both = self.sets.overlap(member, rows)
            either = self.sets.size[rows] + len(words) - both
            alike = np.divide(both, either, out=np.zeros(len(rows)), where=either > 0)
            kind = self._categories(query, rows)
            score = _millionths(alike + np.array(worth)[kind])
            for c in range(3):
                mine = np.flatnonzero(kind == c)
                first = mine[np.lexsort((self.place[rows[mine]], -score[mine]))[: most + 1]]
                found = [(-int(score[i]), self.ids[rows[i]]) for i in first if self.ids[rows[i]] != own]
                best[c] = sorted(best[c] + found)[:most]

        lists = sorted((self.by_word[self.starts[w] : self.starts[w + 1]] for w in known), key=len)
        for done, rows in enumerate(lists):
            if settled((len(lists) - done) / len(words)):
                return looked
            new = rows[~seen[rows]]
            seen[new] = True
            if len(new):
                look(new)
        if not settled(0.0):
            look(np.flatnonzero(~seen))
        return looked


def _blocks(queries: DataFrame, near: list[str], most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in queries.select("query_id", "doc_id", "product", "family", F.array(*map(F.col, near)).alias("near"), F.array_distinct("toks").alias("toks")).toLocalIterator():
        block.append((r.query_id, r.doc_id, r.product, r.family, [sorted(set(x or [])) for x in r.near], list(r.toks or [])))
        size += len(block[-1][5]) + 1
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _compared(near: list[str]) -> list[Column]:
    """What two rows must have alike to be alike in all comparisons."""
    return [F.col("product"), F.col("family"), *(F.array_sort(F.array_distinct(c)) for c in (*near, "toks"))]


def first_of_classes(sides: DataFrame, near: list[str], most: int) -> DataFrame:
    """The rows of the first `most` doc_ids of each class; the window limits a class before its shuffle."""
    place = F.dense_rank().over(Window.partitionBy(*_compared(near)).orderBy("doc_id"))
    return sides.withColumn("place_", place).where(F.col("place_") <= most).drop("place_")


def hard_negatives(queries: DataFrame, docs: DataFrame, near: list[str], most: int = 4, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """query_id, doc_id, category, score, place: two negatives of the same product or family, a close variant, a trap, then the best.

    queries: query_id, doc_id (the positive), product, family, near, toks; docs: doc_id, product, family, near, toks. near: array columns,
    one of which is alike (Jaccard 0.35) in a close variant. The score is the Jaccard similarity of toks and the category's bonus; of equal
    scores smaller doc_ids come first. Every document but the positive is a candidate; those without doc_id are none; null words
    are words like others; null or empty toks are alike to nothing.
    """
    columns = ["product", "family", *near, "toks"]
    text = lambda c: F.col(c) if c in near or c == "toks" else F.col(c).cast("string")
    # One more than can be taken, since a query's own positive is none.
    sides = first_of_classes(docs.where("doc_id is not null").select("doc_id", *(text(c).alias(c) for c in columns)), near, most + 1)
    if sides.rdd.getNumPartitions() < (cores := docs.sparkSession.sparkContext.defaultParallelism):
        sides = sides.repartition(cores)
    sides = checkpointed(sides)  # each block of queries reads it
    class_ = F.md5(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(_compared(near))))))
    members = queries.select(F.col("query_id"), F.col("doc_id").alias("own"), class_.alias("class"))
    kinds = queries.withColumn("class", class_).groupBy("class").agg(*(F.first(c).alias(c) for c in columns)).withColumnRenamed("class", "query_id").withColumn("doc_id", F.lit(None).cast("string"))
    query_type, doc_type = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    names, out = list(BONUS), None
    for block in _blocks(kinds, near, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_WORDS and one query at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            best: list[list[list[tuple]]] = [[[], [], []] for _ in block]
            held: list[pa.RecordBatch] = []
            size, schema = 0, None

            def take() -> None:
                shard = Shard(pa.Table.from_batches(held), near)
                for q, b in zip(block, best, strict=True):
                    shard.search(q, b, most + 1)

            for b in batches:
                schema = b.schema
                held.append(b)
                size += len(b.column("toks").flatten())
                if size >= shard_words:
                    take()
                    held, size = [], 0
            if held:
                take()
            if schema is not None:
                rows = [(q[0], d, names[c], s / -MILLION) for q, kinds in zip(block, best, strict=True) for c, found in enumerate(kinds) for s, d in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], schema.field("doc_id").type), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64())], names=["class", "doc_id", "category", "score"])

        part = sides.mapInArrow(run, f"class string, doc_id {doc_type}, category string, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"query_id {query_type}, doc_id {doc_type}, category string, score double, place int")
    quota = F.create_map(*(F.lit(x) for kv in QUOTA.items() for x in kv))
    # Of each task the best of a category; a first window limits them before the shuffle, and then each query leaves out its own.
    found = out.withColumn("first", F.row_number().over(Window.partitionBy("class", "category").orderBy(F.desc("score"), "doc_id"))).where(F.col("first") <= most + 1).drop("first")
    found = members.join(found, "class").where(~F.col("doc_id").eqNullSafe(F.col("own"))).select("query_id", "doc_id", "category", "score")
    within = F.row_number().over(Window.partitionBy("query_id", "category").orderBy(F.desc("score"), "doc_id"))
    rows = found.withColumn("within", within).where(F.col("within") <= most).withColumn("extra", F.col("within") > quota[F.col("category")])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("extra", F.desc("score"), "doc_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("query_id", "doc_id", "category", "score", "place")
