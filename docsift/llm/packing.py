"""Packing: best-fit decreasing over token windows.

Best-fit decreasing looks at lengths alone, and there are at most `window` of them. So the pieces are counted by length
on the executors, the driver packs the counts (runs of equal windows, found by a segment tree over remaining capacity),
and each piece finds its place from its length and its rank among the pieces of that length. The result is that of one
best-fit-decreasing pass over all pieces; what the driver holds depends on the window, not on the number of documents.

Defined results: null or empty text is one piece holding the end id alone; a text longer than the window is first cut
into full windows; rows that repeat a doc_id are packed one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class SegmentTree:
    """Which remaining capacities have an open window; the smallest of at least n in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Packs counts[length] pieces; spans (length, first rank, pieces a window, first window, offset).

    Piece r of a length lies in the span with the largest first rank up to r, in window first + (r - first rank) // pieces.
    """
    tree, runs, spans, made = SegmentTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = window // length
                n = -(-left // each)
                first, room, made = made, window, made + n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
                each = room // length
                used = -(-left // each)
                if used < n:  # the rest of the run stays open
                    runs[room].append((first + used, n - used))
                    tree.add(room, n - used)
                    n = used
            spans.append((length, rank, each, first, window - room))
            whole, rest = divmod(min(left, n * each), each)
            for at, k, taken in ((first, whole, each), (first + whole, 1, rest)):
                if k and taken:
                    runs.setdefault(room - taken * length, []).append((at, k))
                    tree.add(room - taken * length, k)
            rank += whole * each + rest
            left -= whole * each + rest
    return spans


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None):
    """texts -> lists of ids, as the tokenizer of json_path gives them without adding special tokens.

    With the ranks of the same vocabulary tiktoken encodes, at several times the speed, all texts but those that hold the
    content of one of the tokenizer's added tokens (which is then one id) and those that it cannot manage.
    """

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    if not ranks_path:
        return lambda texts: [x.ids for x in slow().encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f).get("added_tokens", []) if x["content"]]
    marks = re.compile("|".join(map(re.escape, added))) if added else None
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            ids = None
            if not (marks and marks.search(t)):
                try:
                    ids = fast.encode_ordinary(t)
                except BaseException as e:  # tiktoken panics on some texts of one endless word, with a class that it does not export
                    if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                        raise
            out.append(slow().encode(t, add_special_tokens=False).ids if ids is None else ids)
        return out

    return encode


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, window: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Tokens of each document and the end id, cut into windows."""
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for b in common.slices(batches, "text"):
            rows: list[list] = [[] for _ in names]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids.append(end_id)
                flat = np.asarray(ids, "<u4")
                for start in range(0, len(flat), window):
                    part = flat[start : start + window]
                    for r, v in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), len(flat), part.astype("i4")), strict=False):
                        r.append(v)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; with keep_ids also its ids, for sequences()."""
    spark = docs.sparkSession
    common.tune(spark)
    cuts = common.cut(pieces(docs, tokenizer, ranks, window, end_id, keep_ids))
    total = cuts.count()
    shards = max(64, min(65_536, total // 20_000))  # a length that many pieces have is ranked in this many parts
    cuts = cuts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    counted = common.cut(cuts.groupBy("length", "shard").agg(F.count("*").alias("n")), files=common.files_for(64 * shards))
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    spans = best_fit(counts, window)
    before = counted.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = cuts.withColumn("rank", F.row_number().over(order)).join(before, ["length", "shard"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    keys = np.array([(x[0], x[1]) for x in spans], "i8").reshape(-1, 2)
    table = np.array(spans, "i8").reshape(-1, 5)
    order_ = np.lexsort((keys[:, 1], keys[:, 0]))
    shared = spark.sparkContext.broadcast(table[order_])  # some rows a length, at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] * (1 << 45) + t[:, 1]
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s = t[np.searchsorted(key, n * (1 << 45) + r, side="right") - 1]
            past = r - s[:, 1]
            found = [pa.array(s[:, 3] + past // s[:, 2]), pa.array(s[:, 4] + past % s[:, 2] * n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names if c in b.schema.names), *found, *([b.column("ids")] if keep_ids else [])], names=[*names, "sequence_id", "offset", *["ids"] * keep_ids])

    names = PIECES_COLUMNS
    schema = f"{PIECES}, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return ranked.select(*names, "rank", *["ids"] * keep_ids).withColumn("rank", F.col("rank").cast("long")).mapInArrow(place, schema)


PIECES_COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training rows of a packed table that kept its ids: sequence_id, input_ids, n_tokens, doc_ids.

    input_ids are padded to the window, but where the number of tokens is a power of two they stay as they are.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most `window` pieces a sequence
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    whole = F.bit_count("n_tokens") == 1
    pad = F.array_repeat(F.lit(pad_id), F.when(whole, 0).otherwise(F.lit(window) - F.col("n_tokens")).cast("int"))
    return rows.select("sequence_id", F.concat(F.flatten("p.ids"), pad).alias("input_ids"), "n_tokens", F.col("p.doc_id").alias("doc_ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
