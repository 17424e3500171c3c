"""Similarity joins that do not compare all pairs."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.session import checkpointed


#: Sets of up to so many tokens meet by several rare tokens, as many as give KEYS combinations at most.
SHORT_SET, MOST_TOGETHER, KEYS = 16, 6, 40
#: Characters of texts that are broadcast to pairs; beyond that they are joined.
BROADCAST_CHARS = 32_000_000


def _shapes(least: float, sizes: Iterable[int] = range(1, SHORT_SET + 1)) -> list[tuple[int, int, int, list[int]]]:
    """n, lo, hi, places: by which places in a set of n tokens, the rarest first, it meets sets so that the sizes are lo and hi.
    sizes: those that sets have.

    Two sets that share o tokens share L of them among the first n - o + L of each, in any common order.
    """
    out = []
    for lo in sizes:
        for hi in (x for x in sizes if lo <= x <= math.floor(lo / least + 1e-9)):
            shared = math.ceil(least / (1 + least) * (lo + hi) - 1e-9)
            if shared > lo:
                continue
            together = max(x for x in range(1, min(shared, MOST_TOGETHER) + 1) if x == 1 or math.comb(hi - shared + x, x) <= KEYS)
            for n in {lo, hi}:
                out += [(n, lo, hi, list(c)) for c in combinations(range(n - shared + together), together)]
    return out


def _sides(keys: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """keys, with id as a and b, and the columns named with that behind their names."""
    rest = [c for c in keys.columns if c not in ("id", *names)]
    return tuple(keys.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}{k}") for c in names), *rest) for k in ("a", "b"))


def _near(ratio: float) -> Column:
    """False only if the sequence ratio is under `ratio`, since more characters have no partner. letters: of letters(); length."""
    nibble = lambda x, i: F.shiftright(x, 4 * i).bitwiseAND(F.lit(15))
    apart = functools.reduce(operator.add, (F.abs(nibble("lettersa", i) - nibble("lettersb", i)) for i in range(16)))
    return apart <= F.floor(F.lit(1 - ratio) * (F.col("lengtha") + F.col("lengthb")) + 1e-9)


def letters(text: str) -> Column:
    """How often characters of each of 16 kinds occur, 15 at most, in four bits each."""

    def count(t: str | None) -> int:
        n = [0] * 16
        for c in t or "":
            n[ord(c) % 16] += 1
        found = sum(min(x, 15) << 4 * i for i, x in enumerate(n))
        return found - (found >> 63 << 64)

    return F.udf(count, T.LongType(), useArrow=True)(F.col(text))


def _short_pairs(ordered: DataFrame, least: float, ratio: float | None) -> DataFrame:
    """Candidates a, b of sets of up to SHORT_SET tokens."""
    sizes = sorted(r.n for r in ordered.where(F.col("n") <= SHORT_SET).select("n").distinct().collect())  # SHORT_SET at most
    shapes = ordered.sparkSession.createDataFrame(_shapes(least, sizes), "n int, lo int, hi int, places array<int>")
    met = ordered.join(F.broadcast(shapes), "n")  # a fixed number of rows
    more = () if ratio is None else ("letters", "length")
    keys = met.select("id", "n", "lo", "hi", F.xxhash64("lo", "hi", F.transform("places", lambda i: F.get("o", i))).alias("key"), *more)
    left, right = _sides(keys, "n", *more)
    pairs = left.where("na = lo").join(right.where("nb = hi"), ["key", "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))
    return (pairs if ratio is None else pairs.where(_near(ratio))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _long_pairs(ordered: DataFrame, least: float, ratio: float | None) -> DataFrame:
    """Candidates a, b of sets of which one has more than SHORT_SET tokens, by pairs of rare tokens (one, if one is enough)."""
    enough = F.ceil(F.lit(least) * F.col("n") - 1e-9)
    prefix = F.slice("o", 1, F.least("n", F.col("n") - enough + 2).cast("int"))
    two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    one = F.transform("p", lambda x: F.xxhash64(x))
    single = least * 2 <= 1 + 1e-9
    tokens = one if single else F.when(F.col("n") == 1, one).otherwise(two)
    more = () if ratio is None else ("letters", "length")
    keys = ordered.where(F.col("n") >= F.lit(least) * (SHORT_SET + 1) - 1e-9).select("id", "n", prefix.alias("p"), *more).select("id", "n", F.explode(tokens).alias("tok"), *more)
    left, right = _sides(keys, "n", *more)
    sized = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9) & (F.greatest("na", "nb") > SHORT_SET) & (F.col("a") < F.col("b"))
    pairs = left.join(right, "tok").where(sized)
    return (pairs if ratio is None else pairs.where(_near(ratio))).select("a", "b")


def candidates(rows: DataFrame, least: float, ratio: float | None = None) -> DataFrame:
    """a < b: every pair of similarity `least` or more, and others. rows: id, s (distinct tokens), whose copies meet pair by pair.

    With tokens in order of rarity, two sets meet by several of their rarest tokens and by their sizes, as many tokens as any two
    sets of these sizes must share near their beginnings if they are alike. Pairs are dealt by number, whatever their few bytes.
    ratio: pairs whose sequence ratio is surely less are left out; rows have a text too.
    """
    rarity = rows.select(F.explode("s").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    ordered = rows.select("id", F.explode("s").alias("tok")).join(rarity, "tok").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    ordered = ordered.select("id", F.size("o").alias("n"), F.transform("o", lambda x: x["tok"]).alias("o"))
    if ratio is not None:
        ordered = ordered.join(rows.select("id", letters("text").alias("letters"), F.length("text").alias("length")), "id")
    ordered = checkpointed(ordered)
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _short_pairs(ordered, least, ratio).union(_long_pairs(ordered, least, ratio)).repartition(parts, "a", "b").distinct()


def jaccard_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a < b, jaccard (6 decimals) of all pairs of similarity `least` or more. rows: id, s (distinct tokens).

    Exact. Equal sets are one class, and classes are compared if they are candidates. Empty sets are alike to nothing.
    """
    rows = rows.where(F.size("s") > 0).select("id", F.array_sort("s").alias("s"))
    classes = checkpointed(rows.groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    pairs = candidates(classes, least)
    sets = lambda k: classes.select(F.col("id").alias(k), F.col("s").alias(f"s{k}"))
    both = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb") - both
    near = pairs.join(sets("a"), "a").join(sets("b"), "b").where(both >= F.lit(least) * whole - 1e-9).select("a", "b", F.round(both / whole, 6).alias("jaccard"))
    copied = classes.where("copies > 1").select("s", F.col("id").alias("first"))
    if copied.isEmpty():
        return near
    members = checkpointed(rows.join(copied, "s").select("first", "id"))
    of = lambda k: members.select(F.col("first").alias(k), F.col("id").alias(f"m{k}"))
    every = near.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"), "jaccard")
    same = members.select("first", F.col("id").alias("x")).join(members.select("first", F.col("id").alias("y")), "first").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return every.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """Begin in a, begin in b and length of the longest common block; of several the first in a, then in b."""
    i = at = best = 0
    while i + best < len(a):
        if a[i : i + best + 1] in b:
            best, most = best + 1, min(len(a) - i, len(b))
            while best < most:
                middle = (best + most + 1) // 2
                best, most = (middle, most) if a[i : i + middle] in b else (best, middle - 1)
            at = i
        i += 1
    return at, b.find(a[at : at + best]), best


def _matched(a: str, b: str) -> int:
    """Characters in the blocks that SequenceMatcher finds without junk: the longest, then left and right of it."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        i, j, n = _longest(x, y) if x and y else (0, 0, 0)
        if n:
            total += n
            todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.startswith(b[:middle]) else (low, middle - 1)
    return low


def _taken(a: str, b: str, head: int, tail: int) -> bool:
    """True only if SequenceMatcher takes the common prefix and, behind it, suffix as blocks. head, tail: their lengths.

    What is as long as the longer one, and not inside of it, holds the place where a leaves b, with half of what else it holds
    on one side of that place; if neither half is in b, there is no such block. The shorter end then is tried at each place.
    """
    end, odd = len(a) - tail, len(a) - tail - head
    side = ((head + 1 if head >= tail else tail) - odd + 1) // 2
    if side < 1 or a[max(head - side, 0) : head + 1] in b and head >= side or a[max(end - 1, 0) : end + side] in b and tail >= side:
        return False
    if head >= tail:
        rest, other = a[head:], b[head:]
        return other.find(rest[odd:]) == len(other) - tail and not any(rest[i : i + tail] in other for i in range(odd))
    rest, other = a[:end], b[: len(b) - tail]
    return b.find(a[end:]) == len(other) and not any(rest[i : i + head + 1] in other for i in range(odd))


def _ratio(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """SequenceMatcher's ratio, to the bit; None for some that are under `least`.

    SequenceMatcher takes characters frequent in a b of 200 characters or more for junk.
    """
    a, b = a or "", b or ""
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    if a == b:
        return 1.0
    head = _shared(a, b)
    tail = _shared(a[head:][::-1], b[head:][::-1])
    x, y, both = a[head : len(a) - tail], b[head : len(b) - tail], len(a) + len(b)
    if _taken(a, b, head, tail):
        return 2.0 * (head + tail + _matched(x, y)) / both
    if 2.0 * (head + tail + sum(min(x.count(c), y.count(c)) for c in set(x))) / both < least:  # no blocks match more
        return None
    return 2.0 * _matched(a, b) / both


def sequence_ratio(a: str, b: str, least: float = 0.0) -> Column:
    """Ratio of matching blocks, or null if under `least`; for the pairs that a cheaper join left."""

    def ratio(x: str | None, y: str | None) -> float | None:
        return _ratio(x, y, least)

    return F.udf(ratio, T.DoubleType(), useArrow=True)(F.col(a), F.col(b))


def text_pairs(rows: DataFrame, least: float, ratio: float) -> DataFrame:
    """a < b, jaccard and ratio (6 decimals) of all pairs of a similarity and a sequence ratio so high. rows: id, text (distinct), s.

    Exact. Candidates meet their texts once: broadcast, if these have BROADCAST_CHARS characters at most, or by joins. Those whose
    letters differ too much are none, and sets are compared last.
    """
    rows = checkpointed(rows)
    few = (rows.agg(F.sum(F.length("text") + 8)).first()[0] or 0) <= BROADCAST_CHARS
    pairs = candidates(rows, least, ratio)
    for k in ("a", "b"):
        side = rows.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"), F.col("s").alias(f"s{k}"))
        pairs = pairs.join(F.broadcast(side) if few else side, k)
    near = pairs.withColumn("ratio", sequence_ratio("ta", "tb", ratio)).where(F.col("ratio") >= ratio)
    both = F.size(F.array_intersect("sa", "sb"))
    alike = near.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"), F.round("ratio", 6).alias("ratio"))
    return alike.where(F.col("jaccard") >= least - 1e-9).withColumn("jaccard", F.round("jaccard", 6))
