"""The vector sink: what is embedded, written and told, and what is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import vectors

RECORDS = "id long, code string, canonical_id string, title string, product string, standard_kind string, family string, profile string, text string"


def row(i, text, product=None, profile=None):
    return (i, f"C{i}", f"C{i}", "t", product, None, "", profile, text)


def test_only_changed_texts_are_embedded(spark, tmp_path):
    class Counting(vectors.HashingEmbedder):
        def encode(self, texts):
            if any("same" in t for t in texts):
                raise AssertionError("embedded again")
            return super().encode(texts)

    sink = vectors.VectorSink(spark, str(tmp_path / "sink"), "d")
    frame = lambda rows: spark.createDataFrame(rows, RECORDS)
    assert sink.count() == 0 and sink.search(spark.createDataFrame([(1, "x")], "query_id int, text string"), 3).count() == 0
    first = sink.upsert(frame([row(1, "same words"), row(2, "other words", "p")]))
    assert (first["embedded"], first["written"], first["records"], first["errors"]) == (2, 2, 2, [])
    again = sink.upsert(frame([row(1, "same words"), row(2, "new words", "p"), row(3, "third")]), Counting)
    assert (again["embedded"], again["written"], again["records"]) == (2, 2, 3)
    moved = sink.upsert(frame([row(1, "same words", "q")]), Counting)
    assert (moved["embedded"], moved["written"], moved["records"]) == (0, 1, 3)
    assert {r.point_id: r.payload.canonical_product for r in sink.points().collect()} == {"1": "q", "2": "p", "3": None}
    best = sink.search(spark.createDataFrame([(1, "new words")], "query_id int, text string"), 1).first()
    assert best.point_id == "2" and best.score == pytest.approx(1, abs=1e-5)
    other = vectors.VectorSink(spark, str(tmp_path / "sink"), "e")
    assert other.upsert(frame([row(1, "same words")]))["records"] == 1 and sink.count() == 3
    with pytest.raises(ValueError, match="size"):
        sink.ensure(8)
    with pytest.raises(ValueError, match="empty"):
        sink.search(spark.createDataFrame([(1, " ")], "query_id int, text string"), 1)


def test_errors_write_nothing(spark, tmp_path):
    sink = vectors.VectorSink(spark, str(tmp_path / "sink"), "d")
    r = sink.upsert(spark.createDataFrame([row(1, "a"), row(2, " "), row(2, None)], RECORDS))
    assert r["errors"] == ["2 records without text", "1 ids repeat"] and r["records"] == 0 and sink.points() is None


def test_payload_and_odd_profiles(spark):
    rows = spark.createDataFrame([row(1, "x", None, '{"canonical_product": "p", "product_family": ["f"], "applications": []}'), row(2, "x", "own", '{"canonical_product": "p"}'), row(3, "x", None, "no json"), row(4, "x")], RECORDS)
    got = {r.p.standard_id: r.p for r in rows.select(vectors.payload(rows, "d").alias("p")).collect()}
    assert got["1"].canonical_product == "p" and got["1"].product_family == ["f"] and got["2"].canonical_product == "own"
    assert got["3"].canonical_product is None and got["4"].product_family == [] and got["4"].source_dataset == "d" and len(got["4"]) == 10


def test_embed(spark):
    rows = spark.createDataFrame([(1, "A b b"), (2, None), (3, "  "), (4, "--")], "id int, text string")
    got = {r.id: r.vector for r in vectors.embed(rows, "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and got[2] is None and got[3] is None and not any(got[4])
    assert vectors.embed(rows.limit(0), "text").count() == 0
    assert vectors.embed(rows.withColumn("vectors", F.lit(1)), "text").columns == ["id", "text", "vectors", "vector"]


def test_points_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """Tasks that sort vectors grow in number with the points, and a point has one last version."""
    monkeypatch.setattr(vectors, "POINTS", 100)
    none = F.lit(None).cast("string")
    records = spark.range(1000).select("id", F.concat(F.lit("text "), "id").alias("text"), *(none.alias(c) for c in ("code", "canonical_id", "title", "product", "standard_kind", "family", "profile")))
    sink = vectors.VectorSink(spark, str(tmp_path / "sink"), "d")
    sink.upsert(records, name="bounded")
    assert sink.points().rdd.getNumPartitions() >= 10
    assert sink.upsert(records.withColumn("text", F.when(F.col("id") == 7, "new").otherwise(F.col("text"))), name="bounded")["written"] == 1
    assert sink.points().where("version = 2").count() == 1 and sink.count() == 1000
