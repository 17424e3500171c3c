"""Phrases of a taxonomy in texts: an automaton over words, one pass a text, mentions with offsets and scopes.

The taxonomy is broadcast in blocks of a bounded number of words, each a pass over the texts in the same stage; texts stay where they
lie, and each row gets its mentions as an array. Of the mentions of a phrase in one source and scope the first is told, with how often
it stands there, so an array is as long as the taxonomy at most, however long the text.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words of phrases in one automaton: some 100 bytes each in a worker.
BLOCK_WORDS = 1_000_000
#: Runs of letters and digits; with breaks, other characters but white space and _ - / stand between words and part phrases.
WORDS, WORDS_AND_BREAKS = re.compile("[a-z0-9]+"), re.compile(r"[a-z0-9]+|[^a-z0-9\s_\-/]+")

Scopes = Callable[[str], list[tuple[int, int, str]]]


class Automaton:
    """A trie of words with failure links; links to the next node where a phrase ends spare the walk through those between."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for no, words in enumerate(phrases):
            node = 0
            for w in words:
                if w not in self.next[node]:
                    self.next[node][w] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                node = self.next[node][w]
            if node:
                self.ends[node] += (no,)
        self.fail, self.hop = [0] * len(self.next), [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            for w, child in self.next[node].items():
                back = self.fail[node]
                while back and w not in self.next[back]:
                    back = self.fail[back]
                back = self.next[back].get(w, 0)
                self.fail[child], self.hop[child] = back, back if self.ends[back] else self.hop[back]
                todo.append(child)

    def find(self, words: Iterator[str]) -> Iterator[tuple[int, int]]:
        """(phrase, place of its last word) for every occurrence."""
        node = 0
        for at, w in enumerate(words):
            while node and w not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(w, 0)
            end = node if self.ends[node] else self.hop[node]
            while end:
                for no in self.ends[end]:
                    yield no, at
                end = self.hop[end]


class Finder:
    """Phrases with their endings, and how texts part into words."""

    def __init__(self, phrases: list[str], endings: tuple[str, ...], breaks: bool):
        self.pattern = WORDS_AND_BREAKS if breaks else WORDS
        keys = [tuple(self.pattern.findall(p)) for p in phrases]
        own = [(no, k[:-1] + (k[-1] + e,)) for no, k in enumerate(keys) if k for e in ("", *endings)]
        self.of, self.length = [no for no, _ in own], [len(k) for _, k in own]
        self.automaton = Automaton([k for _, k in own])

    def mentions(self, text: str, scopes: Scopes | None) -> dict[tuple[int, str], list[int]]:
        """(phrase, scope): begin and end of the first mention, and their number. A scope is named from the outermost, with / between."""
        begins, ends, words = [], [], []
        for m in self.pattern.finditer(text):
            begins.append(m.start())
            ends.append(m.end())
            words.append(m[0])
        found = sorted((begins[at - self.length[i] + 1], ends[at], self.of[i]) for i, at in self.automaton.find(words))
        out: dict[tuple[int, str], list[int]] = {}
        spans = sorted(scopes(text), key=lambda s: (s[0], -s[1])) if scopes and found else []
        todo, open_ = 0, []
        for begin, end, no in found:
            while todo < len(spans) and spans[todo][0] <= begin:  # a sweep: scopes open and close as mentions go by
                open_.append(spans[todo])
                todo += 1
            open_ = [s for s in open_ if s[1] > begin]
            scope = "/".join(s[2] for s in open_ if s[1] >= end)
            if (no, scope) in out:
                out[no, scope][2] += 1
            else:
                out[no, scope] = [begin, end, 1]
        return out


_finders: dict[str, Finder] = {}


def _finder(key: str, make: Callable[[], Finder]) -> Finder:
    """Built once a worker and taxonomy."""
    if key not in _finders:
        while len(_finders) > 3:
            del _finders[next(iter(_finders))]
        _finders[key] = make()
    return _finders[key]


def _blocks(phrases: DataFrame, most: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in phrases.toLocalIterator():
        if row.phrase is None:
            continue
        block.append(tuple(row))
        size += row.phrase.count(" ") + 1
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def annotate(rows: DataFrame, phrases: DataFrame, texts: list[str], drop: tuple[str, ...] = (), endings: tuple[str, ...] = (), breaks: bool = False, scopes: Scopes | None = None) -> DataFrame:
    """rows without the columns in drop, and mentions: source (the column), scope, begin, end, times, and the columns of phrases.

    phrases: phrase and any others. Phrases and texts are compared as words of the lower-cased text, and offsets count its characters; a
    phrase's last word may have one of the endings; null and empty texts and phrases have no mentions; equal phrases are all told.
    """
    keep = [c for c in rows.columns if c not in drop]
    at = phrases.columns.index("phrase")
    each = StructType([StructField("source", StringType()), StructField("scope", StringType()), *(StructField(n, IntegerType()) for n in ("begin", "end", "times")), *phrases.schema.fields])
    kind = to_arrow_schema(StructType([StructField("m", ArrayType(each))])).field("m").type
    names = [f.name for f in each.fields]
    spark = rows.sparkSession
    lowered = [f"_text{i}" for i in range(len(texts))]
    out = rows.select(*keep, *(F.lower(F.col(c).cast("string")).alias(n) for c, n in zip(texts, lowered, strict=True)), F.array().cast(ArrayType(each)).alias("mentions"))
    ready = phrases.withColumn("phrase", F.lower("phrase"))
    for block in _blocks(ready, BLOCK_WORDS):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))  # BLOCK_WORDS and one phrase at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            key, block = shared.value
            finder = _finder(key, lambda: Finder([r[at] for r in block], endings, breaks))
            for b in batches:
                columns = [b.column(n).to_pylist() for n in lowered]
                found = [[dict(zip(names, (source, scope, *where, *block[no]), strict=True)) for source, text in zip(texts, row, strict=True) if text for (no, scope), where in finder.mentions(text, scopes).items()] for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "_found"])

        schema = StructType([*out.schema.fields, StructField("_found", ArrayType(each))])
        out = out.mapInArrow(run, schema).select(*keep, *lowered, F.concat("mentions", "_found").alias("mentions"))
    return out.drop(*lowered)


def of_field(field: str, mentions: Column | str = "mentions") -> Column:
    return F.filter(mentions, lambda m: m["field"] == field)
