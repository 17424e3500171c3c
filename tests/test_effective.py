"""Effective values and enums on hand-written rows."""

from pyspark.sql import functions as F

from docsift.operators import effective as E

STORED = "standard_id string, title string, scope_text string, retrieval_text string, canonical_product string, family string, product_subtype string, material string, application string, function string, primary_subject string"


def test_effective(spark):
    rows = [
        ("IS 1489 (Part 1): 1991", "cement", None, None, "cement", "c", "x", None, None, None, None),
        ("a", "Glass Fibre_Reinforced pipe insulation", None, None, "lagging", "l", None, "wool", None, None, "s"),
        ("b", None, None, None, None, None, "ordinary_portland_33", None, None, "f", None),
        ("c", "reflux VALVE for potable water and sewage", None, None, "tap", "t", None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = E.effective(spark.createDataFrame(rows, STORED)).collect()
    by = {r.standard_id: [r[f"effective_{f}"] for f in E.FIELDS] for r in got}
    assert by["IS 1489 (Part 1): 1991"] == ["cement", "c", "portland_pozzolana_fly_ash", None, "ppc", "fly_ash", None, None, None, "portland pozzolana fly ash", None]
    assert by["a"] == ["lagging", "l", None, None, None, None, "GRP", "thermal insulation", None, "s", None]
    assert by["b"] == [None, None, "ordinary_portland_33", None, "opc", None, None, None, "f", "ordinary portland 33", None]
    assert by["c"] == ["valve", "water_valve", "check_valve", "check_valve", None, None, None, "potable water supply", "prevent_reverse_flow", "check valve", None]
    assert by[None] == [None] * 11


def test_enums(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda v: F.lit(v).cast("string")
    assert one(E.description_function(lit("reduces Backflow, reduce pressure"))) == "prevent_reverse_flow"
    assert one(E.description_function(lit("  release \n air"))) == "release_air" and one(E.description_function(lit(None))) is None
    assert one(E.cement_type(lit(None), lit("x"), lit("ordinary_portland-cement"))) == "opc"
    assert one(E.head_shape(lit(" round "), lit(None))) == "round" and one(E.head_shape(lit(""), lit("Hexagonal"))) == "hexagonal"
    assert one(E.subtype_family(lit("reflux"), lit("valve"), ["reflux"])) == "check_valve" and one(E.subtype_family(lit("check_valve"), lit("pipe"), ["reflux"])) is None
