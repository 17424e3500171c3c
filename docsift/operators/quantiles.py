"""Exact quantiles of groups of any size, by distributed selection.

A group of at most SMALL values is sorted. In a larger one the interval that holds the wanted rank is narrowed: a mergeable summary of
bounded size proposes CELLS borders, the values between and on the borders are counted exactly, with partial sums before the shuffle,
and the cell of the rank is the next interval. A border that is itself the value ends the search, so ties cost nothing. What the
summary gets wrong costs a round, never the result; a round leaves about one CELLS-th of the values. No task holds a group's values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import checkpointed

#: Values that are sorted in one task, borders of a round, and targets that are broadcast at most.
SMALL, CELLS, BROADCAST_TARGETS = 50_000, 64, 100_000

_INTERVAL = ["_g", "k", "a", "b", "before", "m", "found"]


def _few(targets: DataFrame) -> DataFrame:
    return F.broadcast(targets) if targets.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else targets


def _in_play(values: DataFrame, targets: DataFrame) -> DataFrame:
    inside = (F.col("a").isNull() | (F.col("v") > F.col("a"))) & (F.col("b").isNull() | (F.col("v") < F.col("b")))
    return values.join(_few(targets), "_g").where(inside)


def _narrowed(values: DataFrame, big: DataFrame, cells: int) -> DataFrame:
    borders = F.percentile_approx("v", [i / cells for i in range(cells + 1)], 16 * cells)
    proposed = _in_play(values, big).groupBy("_g", "k").agg(F.array_sort(F.array_distinct(borders)).alias("s"))
    asked = checkpointed(big.drop("found").join(proposed, ["_g", "k"]))
    at = 2 * F.size(F.filter("s", lambda x: x < F.col("v"))) + F.array_contains("s", F.col("v")).cast("int")
    counted = _in_play(values, asked).groupBy("_g", "k", at.alias("cell")).agg(F.count("*").alias("n"))
    sums = Window.partitionBy("_g", "k").orderBy("cell")  # 2 CELLS + 3 rows at most
    cell = counted.withColumn("up", F.sum("n").over(sums)).join(asked, ["_g", "k"])
    chosen = cell.where((F.col("k") - F.col("before") >= F.col("up") - F.col("n")) & (F.col("k") - F.col("before") < F.col("up")))
    i = F.floor(F.col("cell") / 2).cast("int")  # borders below the cell
    on = F.col("cell") % 2 == 1
    return chosen.select(
        "_g", "k", F.when(i > 0, F.get("s", i - 1)).otherwise(F.col("a")).alias("a"), F.coalesce(F.get("s", i), F.col("b")).alias("b"),
        (F.col("before") + F.col("up") - F.col("n")).alias("before"), F.col("n").alias("m"), F.when(on, F.get("s", i)).alias("found"),
    )


def values_at(values: DataFrame, targets: DataFrame, small: int = SMALL, cells: int = CELLS) -> DataFrame:
    """_g, k, value at rank k (from 0) of its group. values: _g, v (double, not null); targets: _g, k, m (values of the group), distinct."""
    none = F.lit(None).cast("double")
    left = checkpointed(targets.select("_g", "k", none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("before"), "m", none.alias("found")))
    while not left.where((F.col("m") > small) & F.col("found").isNull()).isEmpty():
        big = (F.col("m") > small) & F.col("found").isNull()
        left = checkpointed(left.where(~big).select(*_INTERVAL).unionByName(_narrowed(values, left.where(big), cells)))
    rest = _in_play(values, left.where("found is null"))
    place = F.row_number().over(Window.partitionBy("_g", "k").orderBy("v")) - 1  # SMALL rows at most
    sorted_ = rest.withColumn("place", place).where(F.col("place") == F.col("k") - F.col("before")).select("_g", "k", F.col("v").alias("value"))
    return left.where("found is not null").select("_g", "k", F.col("found").alias("value")).unionByName(sorted_)


def quantiles(rows: DataFrame, value: str, by: list[str], want: dict[str, float], small: int = SMALL, cells: int = CELLS) -> DataFrame:
    """by and a column for each quantile wanted, linearly interpolated between the two nearest ranks.

    Nulls count for nothing, NaN is the greatest; a group without values is not told; null keys are a group.
    """
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    values = rows.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("v"))
    sizes = checkpointed(values.groupBy("_g").agg(F.count("*").alias("m")))
    low = lambda p: F.floor(F.lit(float(p)) * (F.col("m") - 1)).cast("long")
    high = lambda p: F.least(low(p) + 1, F.col("m") - 1)
    ranks = F.array_distinct(F.array(*(r for p in want.values() for r in ((low(p), high(p)) if not math.isclose(p, 0) and not math.isclose(p, 1) else (low(p),)))))
    found = values_at(values, sizes.select("_g", "m", F.explode(ranks).alias("k")), small, cells)
    by_rank = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))  # two ranks a quantile
    told = sizes.join(by_rank, "_g")

    def between(p: float):
        part = F.lit(float(p)) * (F.col("m") - 1) - low(p)
        a, b = F.try_element_at("at", low(p)), F.try_element_at("at", high(p))
        return F.when(part > 0, a + (b - a) * part).otherwise(a)

    return told.select(*(F.col("_g")[c].alias(c) for c in by), *(between(p).alias(name) for name, p in want.items()))


def with_quantiles(rows: DataFrame, value: str, by: list[str], want: dict[str, float], *sums, **how) -> DataFrame:
    """The sums of each group and its quantiles."""
    told = rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)
    q = quantiles(rows, value, by, want, **how)
    if not by:
        return told.join(F.broadcast(q), F.lit(True), "left")  # a row each
    named = q.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), *want)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return told.join(named, same, "left").drop(*(f"_{i}" for i in range(len(by))))
