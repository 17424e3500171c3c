"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; its low 16 bits, which the last 16 bytes alone decide, say where chunks end.
So an insertion moves no boundary further than 16 bytes away, and a passage falls into the same chunks wherever it
stands. Of each chunk (by its 128-bit digest) the first occurrence stays: that in the smallest doc_id, and there the
first. A run of later occurrences is extended, to the character, as far as the text around it equals the text around the first
occurrence, however far that is, and goes if it is `least` characters long then; shorter ones are too common to tell.

Only digests that repeat are joined back to their places. Digests of so many places that one task would feel it are few by
counting; what they own is broadcast, and the places of all others meet by shuffle. Then runs, not chunks, go on.

Defined results: null text has no chunks and stays null; an empty text stays empty; very long texts are cut whole, one at a
time; rows that share doc_id and text count as one document, so neither loses to the other; different texts under one
doc_id are different documents, ordered by a hash of their text; of a null doc_id nothing is removed and it counts as no
occurrence; an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .minhash import BROADCAST_IDS, mix

U = np.uint64
#: A random 64-bit value for each byte.
GEAR = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
#: Mean bytes of a chunk, the most bytes of one, and the fewest characters of a run that is removed.
MEAN, MOST, LEAST = 32, 4096, 80
#: Characters by which the ends of a run move at first (twice as many each round), and the shortest run that is tried.
EDGE, TRIED = 256, 40
#: A digest of at least FEW_PLACES places and of one HOT-th of all is hot; hence there are at most HOT of them.
FEW_PLACES, HOT = 1000, 50_000
#: What is broadcast of spans or contexts, at most.
BROADCAST_BYTES = 24 << 20


def boundaries(data: bytes, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Ends of the chunks, on character boundaries; the last is the length."""
    b = np.frombuffer(data, "u1")
    h = GEAR[b]
    for width in (1, 2, 4, 8):  # after which a value spans 2, 4, 8, 16 bytes
        h[width:] = h[width:] + (h[:-width] << U(width))
    ends = np.flatnonzero((h & U(0xFFFF)) < U(65_536 // mean)) + 1
    ends = np.append(ends[ends < len(b)], len(b))
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > most:  # no boundary for long: cut at fixed distances from the last one
        extra = [np.arange(e - g + most, e, most) for e, g in zip(ends[gaps > most], gaps[gaps > most], strict=True)]
        ends = np.unique(np.concatenate([ends, *extra]))
    while len(ends) > 1:  # an end inside a character moves to the next one's start
        inside = (b[ends[:-1]] & 0xC0) == 0x80
        if not inside.any():
            break
        ends[:-1] += inside
        ends = np.unique(ends)
    return ends


def chunks(text: str, mean: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (n x 2, uint64), starts and ends in characters."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return np.empty((0, 2), U), np.empty(0, "i8"), np.empty(0, "i8")
    ends = boundaries(data, mean, most)
    cuts = [0, *ends.tolist()]
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)), U).reshape(-1, 2)
    begun = (np.frombuffer(data, "u1") & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(begun)])[cuts]
    return digest, chars[:-1], chars[1:]


def _keyed(docs: DataFrame, repeated: bool) -> DataFrame:
    """doc_id, t, text; t tells the texts of one doc_id apart, if rows repeat a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("t"), text.alias("text"))


def _arrow(docs: DataFrame, schema: str, row) -> DataFrame:
    """Rows of int64 columns that row(doc_id, t, text) gives as arrays. docs: doc_id, t, text."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 1_000_000):
            parts = [row(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "text")), strict=True) if x[2] and x[0] is not None]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


def _counted(mean: int, most: int):
    """First half of each digest of a document, and how often it stands there."""

    def row(doc: int, t: int, text: str) -> tuple[np.ndarray, ...]:
        key, n = np.unique(chunks(text, mean, most)[0][:, 0], return_counts=True)
        return key.view("i8"), n

    return row


def _placed(mean: int, most: int):
    """Each chunk: digest, document, and start * 2 ** 32 + length."""

    def row(doc: int, t: int, text: str) -> tuple[np.ndarray, ...]:
        digest, start, end = chunks(text, mean, most)
        d = digest.view("i8")
        return d[:, 0], d[:, 1], np.full(len(d), doc, "i8"), np.full(len(d), t, "i8"), (start << 32) + (end - start)

    return row


_LATER = "doc_id long, t long, start long, end long, owner long, owner_t long, first long"
_RUN = "doc_id long, t long, start long, end long, lo long, lt long, lp long, ro long, rt long, rp long"


def _later(docs: DataFrame, mean: int, most: int, files: int) -> DataFrame:
    """_LATER: the later occurrences of chunks, and where each chunk stands first. docs: doc_id, t, text."""
    # Half a digest tells what may repeat; whether it does, and where first, the whole digest tells.
    may = common.cut(_arrow(docs, "d1 long, n long", _counted(mean, most)).groupBy("d1").agg(F.sum("n").alias("n")).where("n > 1"), files=files)
    rows, total = may.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    may = may.select("d1", (F.col("n") >= max(FEW_PLACES, total / HOT)).alias("hot"))
    places = _arrow(docs, "d1 long, d2 long, doc_id long, t long, at long", _placed(mean, most))
    hits = common.cut(places.join(F.broadcast(may) if rows <= BROADCAST_IDS // 4 else may, "d1"), files=files)
    place = F.struct("doc_id", "t", "at")
    # A few task's worth of rows a digest: sorted once, the first tells the rest.
    order = Window.partitionBy("d1", "d2").orderBy("doc_id", "t", "at")
    cold = hits.where("not hot").withColumn("first", F.first(place).over(order)).where(place != F.col("first")).select("doc_id", "t", "at", "first")
    owners = common.cut(hits.where("hot").groupBy("d1", "d2").agg(F.min(place).alias("first")), files=files)
    # Digests that share a hot half are no more than the hot halves but for collisions of 64 bits.
    hot = hits.where("hot").join(F.broadcast(owners), ["d1", "d2"]).where(place != F.col("first")).select("doc_id", "t", "at", "first")
    start = lambda c: F.shiftrightunsigned(c, 32)
    return cold.union(hot).select("doc_id", "t", start("at").alias("start"), (start("at") + F.col("at").bitwiseAND(0xFFFFFFFF)).alias("end"), F.col("first.doc_id").alias("owner"), F.col("first.t").alias("owner_t"), start("first.at").alias("first"))


def _runs(later: DataFrame) -> DataFrame:
    """_RUN: runs of later occurrences, TRIED characters at least, and where what they begin (l) and end with (r) stands first."""
    found = later.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("start", "end", "owner", "owner_t", "first"))).alias("found"))  # bounded by the document
    names = [x.split()[0] for x in _RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = []
            for doc, t, chunks_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "found")), strict=True):
                merged: list[list[int]] = []
                for x in chunks_:
                    last = [x["owner"], x["owner_t"], x["first"] + x["end"] - x["start"]]
                    if merged and x["start"] <= merged[-1][3]:
                        merged[-1][3] = x["end"]
                        merged[-1][7:] = last
                    else:
                        merged.append([doc, t, x["start"], x["end"], x["owner"], x["owner_t"], x["first"], *last])
                out += [m for m in merged if m[3] - m[2] >= TRIED]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)

    return found.mapInArrow(run, _RUN)


_EDGE = "doc_id long, t long, start long, end long, left boolean, at long, o long, ot long, p long, open boolean"


def _contexts(docs: DataFrame, edges: DataFrame, width: int, files: int) -> DataFrame:
    """o, ot, p, left, context: the width characters before or after places p of texts o, ot."""
    ask = edges.select("o", "ot", "p", "left").distinct()
    ask = common.cut(ask.groupBy("o", "ot").agg(F.collect_list(F.struct("p", "left")).alias("places")), files=files)  # bounded by the document
    few = ask.agg(F.coalesce(F.sum(F.size("places") * 16 + 40), F.lit(0))).first()[0] <= BROADCAST_BYTES
    asked = docs.join(F.broadcast(ask) if few else ask, (F.col("doc_id") == F.col("o")) & (F.col("t") == F.col("ot"))).select("o", "ot", "places", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            out = []
            for o, ot, places, text in zip(*(b.column(c).to_pylist() for c in ("o", "ot", "places", "text")), strict=True):
                out += [(o, ot, x["p"], x["left"], text[max(0, x["p"] - width) : x["p"]] if x["left"] else text[x["p"] : x["p"] + width]) for x in places]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["o", "ot", "p", "left", "context"])

    found = asked.mapInArrow(run, "o long, ot long, p long, left boolean, context string")
    return common.cut(found.groupBy("o", "ot", "p", "left").agg(F.first("context").alias("context")), old=[ask], files=files)


def alike(a: str, b: str, left: bool) -> int:
    """How many characters a and b share at their ends (left) or beginnings."""
    least, most = 0, min(len(a), len(b))
    same = (lambda n: a[len(a) - n :] == b[len(b) - n :]) if left else (lambda n: a[:n] == b[:n])
    if same(most):
        return most
    while most - least > 1:
        n = (least + most) // 2
        least, most = (n, most) if same(n) else (least, n)
    return least


def _moved(docs: DataFrame, edges: DataFrame, width: int, files: int) -> DataFrame:
    """edges, each further out by what is equal of the next width characters; open if all are."""
    around = _contexts(docs, edges, width, files)
    few = around.agg(F.coalesce(F.sum(F.length("context") + 40), F.lit(0))).first()[0] <= BROADCAST_BYTES
    # A stage of one join, so that adaptive execution can split the places that many runs point to.
    told = common.cut(edges.join(F.broadcast(around) if few else around, ["o", "ot", "p", "left"]), old=[around], files=files)
    one = F.struct("start", "end", "left", "at", "o", "ot", "p", "context")
    by_doc = common.cut(told.groupBy(F.col("doc_id").alias("of"), F.col("t").alias("of_t")).agg(F.collect_list(one).alias("edges")), old=[told], files=files)  # bounded by the document
    sizes = F.aggregate("edges", F.lit(40), lambda n, x: n + F.length(x["context"]) + 60)
    few = by_doc.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0] <= BROADCAST_BYTES
    met = docs.join(F.broadcast(by_doc) if few else by_doc, (F.col("doc_id") == F.col("of")) & (F.col("t") == F.col("of_t"))).select("doc_id", "t", "text", "edges")
    names = [x.split()[0] for x in _EDGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            out = []
            for doc, t, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "text", "edges")), strict=True):
                for x in found:
                    at, left = x["at"], x["left"]
                    n = alike(text[max(0, at - width) : at] if left else text[at : at + width], x["context"], left)
                    step = -n if left else n
                    out.append((doc, t, x["start"], x["end"], left, at + step, x["o"], x["ot"], x["p"] + step, n == width))
            kinds = [pa.bool_() if c in ("left", "open") else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return common.cut(met.mapInArrow(run, _EDGE).dropDuplicates(), old=[by_doc], files=files)  # rows that repeat tell the same


def repeated_runs(docs: DataFrame, mean: int, most: int, files: int) -> DataFrame:
    """doc_id, t, runs (array of start, end, source), each as long as the text around it equals that around its first occurrence.

    Both ends of a run move out in rounds of doubling width, EDGE characters first; only ends of which all characters were equal
    go on, so the rounds are as many as the logarithm of the longest way. docs: doc_id, t, text.
    """
    runs = common.cut(_runs(_later(docs, mean, most, files)), files=files)
    key = ["doc_id", "t", "start", "end"]
    side = lambda left, at, o, t, p: runs.select(*key, F.lit(left).alias("left"), F.col(at).alias("at"), F.col(o).alias("o"), F.col(t).alias("ot"), F.col(p).alias("p"))
    edges = side(True, "start", "lo", "lt", "lp").union(side(False, "end", "ro", "rt", "rp"))
    width, closed = EDGE, []
    while True:
        moved = _moved(docs, edges, width, files)
        closed.append(moved.where("not open").select(*key, "left", "at"))
        edges = moved.where("open").drop("open")
        if not edges.limit(1).count():
            break
        width *= 2
    ends = closed[0]
    for x in closed[1:]:
        ends = ends.union(x)
    ends = ends.groupBy(*key).agg(F.min(F.when(F.col("left"), F.col("at"))).alias("from"), F.max(F.when(~F.col("left"), F.col("at"))).alias("to"))
    wide = runs.select(*key, "lo").join(ends, key)
    out = wide.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("start"), F.col("to").alias("end"), F.col("lo").alias("source")))).alias("runs"))  # bounded by the document
    return common.cut(out, old=[runs], files=files)


def merged(runs: list[dict], least: int) -> list[dict]:
    """Sorted runs that overlap or touch become one; those of least characters or more."""
    out: list[dict] = []
    for x in runs:
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append({"start": x["start"], "end": x["end"], "source": x["source"]})
    return [x for x in out if x["end"] - x["start"] >= least]


def _without(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def dedup_substrings(docs: DataFrame, mean: int = MEAN, most: int = MOST, least: int = LEAST, spans: str = "spans", removed: str = "n_removed") -> DataFrame:
    """docs with the text that stays, and two columns more: the spans that went (start, end in characters, and the document
    that has their first chunk first; null if none) and how many characters they held."""
    common.tune(docs.sparkSession)
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("most")).first()
    files, repeated = common.files_for(ids.n or 0), (ids.most or 0) > 1
    of, of_t, runs = (common.free(docs, x) for x in ("_run_of", "_run_t", "_runs"))
    found = repeated_runs(_keyed(docs, repeated), mean, most, files).select(F.col("doc_id").alias(of), F.col("t").alias(of_t), F.col("runs").alias(runs))
    few = _bytes(found, runs) <= BROADCAST_BYTES
    docs = docs.drop(spans, removed).withColumn("text", F.col("text").cast("string"))
    same = F.col("doc_id").cast("long") == F.col(of)
    if repeated:
        same &= F.xxhash64("text") == F.col(of_t)
    joined = docs.join(F.broadcast(found) if few else found, same, "left").drop(of, of_t)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "source")]))
    names = docs.columns

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            text, gone, n = b.column("text").to_pylist(), [None] * b.num_rows, [0] * b.num_rows
            for i, found_ in enumerate(b.column(runs).to_pylist()):
                if found_ and text[i] is not None and (long := merged(found_, least)):
                    text[i], gone[i], n[i] = _without(text[i], long), long, sum(x["end"] - x["start"] for x in long)
            columns = [pa.array(text, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, kind), pa.array(n, pa.int64())], names=[*names, spans, removed])

    item = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "source")])
    return joined.mapInArrow(without, T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(item)), T.StructField(removed, T.LongType())]))


def _bytes(found: DataFrame, runs: str) -> int:
    return found.agg(F.coalesce(F.sum(F.size(runs) * 40 + 40), F.lit(0))).first()[0]


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's removed spans and what is left of it."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).alias("n_spans"), "n_removed", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_kept"), "spans", "text")
