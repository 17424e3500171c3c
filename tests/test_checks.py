"""Checks inside a write: what stops it, what passes, and that nothing is scanned twice."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docsift.operators import checks

def pairs(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query string, label int")


def write(df, path, **expected):
    return checks.write_checked(df, path, {"label is 0 or 1": F.col("label").isin(0, 1)}, F.col("query_id"), {"n": F.count("*"), "positives": F.sum("label")}, expected)


def test_a_good_set_is_published_and_a_bad_one_leaves_it(spark, tmp_path):
    path = str(tmp_path / "set")
    assert write(pairs(spark, [(1, "a", 1), (1, "a", 0)]), path, n=2, positives=lambda n: n == 1) == {"n": 2, "positives": 1}
    with pytest.raises(PySparkException, match="label is 0 or 1: 7"):
        write(pairs(spark, [(1, "a", 1), (7, "a", 2)]), path)
    with pytest.raises(PySparkException, match="label is 0 or 1: null"):
        write(pairs(spark, [(None, "a", None)]), path)
    with pytest.raises(checks.CheckFailed, match="n is 1, not 3"):
        write(pairs(spark, [(1, "a", 1)]), path, n=3)
    assert sorted(map(tuple, checks.read_checked(spark, path).collect())) == [(1, "a", 0), (1, "a", 1)]
    assert write(pairs(spark, []), path, n=0)["n"] == 0 and checks.read_checked(spark, path).count() == 0


def test_a_leaking_query_stops_the_write(spark, tmp_path):
    frozen = spark.createDataFrame([("Need  Cement",), (None,)], "text string")
    path = str(tmp_path / "set")
    good = checks.without_leaks(pairs(spark, [(1, "need lime", 1), (2, None, 0)]), frozen)
    assert write(good, path)["n"] == 2
    with pytest.raises(PySparkException, match="leaks from a frozen set: need cement "):
        write(checks.without_leaks(pairs(spark, [(1, "need cement ", 1)]), frozen), path)
    assert checks.read_checked(spark, path).count() == 2


def test_one_scan(spark, tmp_path):
    source = str(tmp_path / "source")
    pairs(spark, [(1, "a", 1)]).write.parquet(source)
    df = checks.guarded(spark.read.parquet(source), {"label": F.col("label").isin(0, 1)}, F.col("query_id")).observe("o", F.count("*").alias("n"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "raise_error" in plan
