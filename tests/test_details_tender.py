"""Facts and tender items of hand-written texts."""

import pytest
from pyspark.sql import functions as F

from docsift.operators import details as D
from docsift.operators import tender
from docsift.plans import registry


def told(text, section=None):
    return [(f["name"], f["value"], f["unit"]) for f in D.details(text) if section in (None, f["section"])]


def test_sizes_keep_away_from_tolerances_and_tests():
    assert told("The nominal size shall be 190 x 90 X 40 mm.", "size") == [("Nominal size", "190 × 90 × 40 mm", "mm")]
    assert told("The size tolerance is 190 x 90 mm.", "size") == []
    assert told("In the test a size of 190 x 90 mm is taken.", "size") == []
    assert told("A block of 190 x 90 mm.", "size") == []
    assert told("Pipes of 110 mm nominal diameter.", "size") == [("Nominal diameter", "110 mm", "mm")]
    assert told("nominal diameter of 2.5 m, nominal diameter of 2.5 m", "size") == [("Nominal diameter", "2.5 m", "m")]


def test_dimensions():
    text = "Length and breadth: Average ± 3mm, individual ±  5 mm. Groove shall not exceed 2 mm. Warpage shall not exceed 1.5 percent along edges and 2 percent along diagonals."
    assert told(text, "dimension") == [
        ("Groove/frogging depth", "maximum 2 mm", "mm"),
        ("Length/breadth tolerance", "Average ±3 mm; Individual ±5 mm", "mm"),
        ("Warpage", "maximum 1.5 percent along edges; maximum 2 percent along diagonals", "percent"),
    ]
    assert D.signed_value("+- 5mm") == "±5 mm" and D.signed_value("5") == "5"


def test_temperatures():
    assert told("Operating temperature up to 60 deg C.", "temperature") == [("Maximum temperature", "60", "C"), ("Temperature", "60 C", "C")]
    assert told("Service temperature from 10 °C to 40 °C.", "temperature") == [("Temperature range", "10 C to 40 C", "C"), ("Temperature", "10 C", "C"), ("Temperature", "40 C", "C")]
    assert told("Kept at 60 degrees Celsius.", "temperature") == []


def test_grades_classes_and_table():
    assert told("43 grade and CLASS 2", "grade") == [("Grade/Class", "43 grade", None), ("Grade/Class", "Grade and", None), ("Grade/Class", "Class 2", None)]
    text = "Classification: Class 1, Class 2 and Class 3. Water absorption 10 12.5 15 percent, Max; 15 mm thick 25 20 15"
    assert [v for _, v, _ in told(text, "classification")] == ["Class 1", "Class 2", "Class 3"]
    assert told(text, "table") == [("Water absorption maximum", "Class 1 = 10 percent; Class 2 = 12.5 percent; Class 3 = 15 percent", "percent"), ("Impact test - 15 mm tile", "Class 1 = 25 mm; Class 2 = 20 mm; Class 3 = 15 mm", "mm")]
    assert told(text, "performance") == []


def test_sentences():
    text = "The compressive strength shall be 5 units. Strength is good and this is a fact. Its surface shall be smooth and even.\nshort shall"
    assert told(text, "performance") == [("Compressive strength", "The compressive strength shall be 5 units.", None)]
    assert told(text, "other") == [("Finish", "Its surface shall be smooth and even.", None)]
    free = "Workmanship: tiles shall be free from cracks, warps and other visible defects of any kind."
    assert told(free, "workmanship") == [("Workmanship", free, None)]


def test_edges_and_places(spark):
    assert D.details(None) == [] and D.details("") == []
    long = "x " * 200_000 + "The nominal size is 1 x 2 mm."
    (fact,) = D.details(long)
    assert long[fact["begin"] : fact["end"]] == "1 x 2 mm" and fact["evidence"].endswith("1 x 2 mm.")
    many = " ".join(f"nominal diameter {i} mm." for i in range(30))
    assert [v for _, v, _ in told(many)] == [f"{i} mm" for i in range(12)] and len(D.details(many, None)) == 30
    rows = spark.createDataFrame([(1, "Grade A"), (2, None)], "id long, text string").select("id", D.extract_details(F.col("text")).alias("f")).orderBy("id").collect()
    assert [len(r.f) for r in rows] == [1, 0]


def test_material_and_name(spark):
    rows = [(1, "Clay roofing tiles", "steel", None), (2, "Tiles", "Steel", "a steel ball is dropped"), (3, "Tiles", "steel", "steel frames"), (4, None, None, None), (5, "UPVC pipes", "", ""), (6, "Tiles", "brass", "brass test")]
    df = spark.createDataFrame(rows, "id long, h string, m string, s string")
    got = [r.v for r in df.select("id", D.validated_material(F.col("h"), F.col("m"), F.col("s")).alias("v")).orderBy("id").collect()]
    assert got == ["clay", None, "steel", None, "UPVC", "brass"]
    names = spark.createDataFrame([(1, None, "BURNT CLAY-TILES 2ND"), (2, "", "roofing_tile of  clay"), (3, "", None), (4, "aB", "x")], "id long, a string, b string")
    assert [r.v for r in names.select("id", D.product_name(F.col("a"), F.col("b")).alias("v")).orderBy("id").collect()] == ["Burnt Clay-Tiles 2Nd", "Roofing tile of clay", None, "AB"]


def test_tender_items(spark):
    rows = [
        (1, "Item No. 4(a): Supply of UPVC pipes of 110.0 mm nominal diameter for soil and waste drainage in the building. With bends, excluding fittings/tees. Watertight."),
        (2, "gate valve"), (3, "  \n"), (4, None), (5, "supply new 12"), (6, "Pressure reducing valve, diameter of 2.50 mm"), (7, "Provide bricks, payment on completion"),
    ]
    got = {r.item: r for r in tender.extract(spark.createDataFrame(rows, "item long, text string")).collect()}
    assert set(got) == {1, 2, 5, 6, 7}
    a = got[1]
    assert (a.item_no, a.product, a.material, a.function, a.diameter_mm) == ("4(a)", "UPVC drainage pipe", ["UPVC"], [], 110.0)
    assert a.application == ["soil drainage", "waste drainage", "building drainage"] and a.installation == ["building drainage"]
    assert a.components == ["fittings", "bends", "tees"] and a.excluded == ["fittings/tees"] and a.requirements == ["watertight"]
    assert a.description == "UPVC drainage pipe, UPVC, soil drainage, waste drainage, building drainage, 110 mm nominal diameter"
    said = {(e.field, e.value): e for e in a.evidence}
    assert said["material", "UPVC"].evidence.startswith("4(a): Supply of UPVC pipes") and not said["material", "UPVC"].inferred
    assert said["dimensions.diameter", "110 mm"].evidence.startswith("4(a)")
    b = got[2]
    assert (b.item_no, b.product, b.ambiguity, b.missing, b.description) == ("2", "valve", True, ["product subtype/function"], "valve, gate valve")
    assert got[5].product == "procurement item"
    assert (got[6].product, got[6].function, got[6].description) == ("pressure reducing valve", ["reduce_pressure"], "pressure reducing valve, reduce_pressure, 2.5 mm nominal diameter")
    reduce = next(e for e in got[6].evidence if e.field == "function")
    assert reduce.evidence.startswith("Pressure reducing") and not reduce.inferred
    assert got[7].product == "bricks" and got[7].description == "bricks, Provide bricks, on"


@pytest.mark.parametrize("name", ["detail_extract", "tender_extract"])
def test_one_row_group_is_work_for_all_cores(spark, tmp_path, name):
    """Of a file's splits only one has the rows of its one row group; the rest would be idle."""
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in was:
            spark.conf.set(k, "1024")
        found = registry.queries()[name](spark, str(tmp_path))
        assert found.select(F.spark_partition_id()).distinct().count() == found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
