"""Benchmark decontamination by pigeonhole edit matching.

An item of m normalised characters may differ by k = floor(m * rate) edits from a passage that gives it away. Cut into k + 1
pieces, at least one piece stands in the passage unchanged. An Aho-Corasick automaton finds all pieces in one pass over
each whole document; around each hit Myers' bit-parallel automaton gives the exact smallest distance and where it ends.

Normalised text: lower case, each run of characters that are neither letters nor digits is one space. The items are read
in blocks of bounded size, each broadcast by itself, so the benchmark may grow too.

Defined results: null or empty documents and items match nothing; items of fewer than `shortest` normalised characters
match exactly and as whole words alone, those without letters or digits nothing; repeated items and rows are matched one
by one; items of one id are told by their best match; empty tables give an empty result; more columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE, SHORTEST = 0.08, 32
#: Normalised characters of items in one block.
BLOCK_CHARS = 4_000_000

SEPARATOR = re.compile(r"[\W_]+")


def normalise(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Normalised text, and (position there, shift to the original) wherever the shift changes."""
    out, shifts, at, length = [], [(0, 0)], 0, 0
    for m in SEPARATOR.finditer(text):
        word = text[at : m.start()]
        low = word.lower()
        if len(low) != len(word):  # a few letters change their length
            low = "".join(c.lower()[:1] for c in word)
        out += (low, " ")
        length += len(low) + 1
        at = m.end()
        if at - length != shifts[-1][1]:
            shifts.append((length, at - length))
    word = text[at:]
    low = word.lower()
    out.append(low if len(low) == len(word) else "".join(c.lower()[:1] for c in word))
    return "".join(out), shifts


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly one length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of text, and the first end where it is reached."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class Matcher:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float, shortest: int = SHORTEST):
        import ahocorasick

        self.shortest = shortest
        self.items = [(i, t, budget(t, rate) if len(t) >= shortest else 0, masks(t), masks(t[::-1])) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _, _) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end in characters of text) of the best match of each item."""
        if not text:
            return []
        norm, shifts = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for last, (size, where) in self.automaton.iter(norm):
            for n, offset in where:
                _, item, k, _, _ = self.items[n]
                if len(item) < self.shortest:  # one piece, the whole item
                    begin, end = last + 1 - size, last + 1
                    if (begin == 0 or norm[begin - 1] == " ") and (end == len(norm) or norm[end] == " "):
                        best.setdefault(self.items[n][0], (0, begin, end))
                    continue
                begin = last + 1 - size - offset - k
                found = windows.setdefault(n, [])
                end = begin + len(item) + 2 * k
                if found and begin <= found[-1][1] - len(item) and found[-1][0] <= begin:  # the same passage, or nearly
                    found[-1][1] = max(found[-1][1], end)
                else:
                    found.append([begin, end])
        for n, found in windows.items():
            key, item, k, peq, rev = self.items[n]
            for begin, end in found:
                begin = max(0, begin)
                part = norm[begin:end]
                distance, stop = myers(peq, len(item), part)
                if distance <= k and (key not in best or distance < best[key][0]):
                    _, back = myers(rev, len(item), part[:stop][::-1])
                    best[key] = (distance, begin + stop - back, begin + stop)
        return [(key, d, _original(shifts, s), _original(shifts, e - 1) + 1) for key, (d, s, e) in best.items()]


def _original(shifts: list[tuple[int, int]], at: int) -> int:
    from bisect import bisect_right

    return at + shifts[bisect_right(shifts, (at, 1 << 60)) - 1][1]


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], rate: float, shortest: int) -> Matcher:
    return Matcher(list(items), rate, shortest)


def blocks(benchmark: DataFrame, chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Normalised items, a bounded number at a time."""
    block, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        item = normalise(row.t)[0].strip()
        if not item:
            continue
        if block and size + len(item) > chars:
            yield tuple(block)
            block, size = [], 0
        block.append((row.i, item))
        size += len(item)
    if block:
        yield tuple(block)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: the best match of each item in each document that has one."""
    common.tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "distance", "start", "end"]
    out = None
    for block in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # block_chars at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate, shortest)
            for b in common.slices(batches, "text"):
                rows = [(doc, *m) for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in matcher.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
