"""Exact quantiles by selection against sorting, with heavy ties, wide ranges, one huge group and odd cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import evaluation, quantiles


def sorted_quantile(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    low = math.floor(at)
    high = min(low + 1, len(v) - 1)
    return v[low] + (v[high] - v[low]) * (at - low)


GROUPS = {
    "uniform": lambda r: [r.uniform(-5, 5) for _ in range(3000)],
    "ties": lambda r: [float(r.choice([1, 1, 1, 1, 2, 3])) for _ in range(2000)],
    "one value": lambda r: [7.0] * 900,
    "wide": lambda r: [math.exp(r.uniform(-600, 600)) for _ in range(2500)],
    "few": lambda r: [3.0, 1.0],
    "one": lambda r: [4.5],
    None: lambda r: [float(i) for i in range(500)],
}


@pytest.mark.parametrize(("small", "cells"), [(50_000, 64), (40, 8)])
def test_quantiles_equal_sorting(spark, small, cells):
    r = random.Random(1)
    values = {g: f(r) for g, f in GROUPS.items()}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("uniform", None), ("nothing", None)]
    r.shuffle(rows)
    want = {"low": 0.0, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = quantiles.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"], want, small, cells).collect()
    assert {x.g for x in got} == set(values)
    for x in got:
        for name, p in want.items():
            assert x[name] == pytest.approx(sorted_quantile(values[x.g], p), rel=1e-12), (x.g, name)


def test_one_huge_group_is_split_and_no_buffer_holds_it(spark):
    rows = spark.range(400_000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 400_000).cast("double").alias("v"))
    out = quantiles.quantiles(rows, "v", ["g"], {"mid": 0.5, "p95": 0.95}, small=1000)
    assert tuple(out.first()) == ("a", 199_999.5, pytest.approx(0.95 * 399_999))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_summaries(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "v double")
    d = evaluation.distribution(rows, "v", []).first()
    assert (d.n, d.min, d.max, d.median) == (3, 1.0, 10.0, 2.0)
    none = evaluation.distribution(rows.limit(0), "v", []).collect()
    assert len(none) == 1 and none[0].n == 0 and none[0].median is None
    assert evaluation.latency(rows.limit(0).withColumn("g", F.lit(1)), "v", ["g"]).count() == 0
