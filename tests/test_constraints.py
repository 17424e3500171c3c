import pytest
from pyspark.sql import functions as F

from docsift.operators import constraints as C


def state(spark, how, q, c):
    return spark.createDataFrame([(q, c)], "q string, c string").select(how(F.col("q"), F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "q, c, want",
    [("plastic", "steel", "CONTRADICTION"), ("plastic", "HDPE", "STRONG_COMPATIBLE"), ("fibrous", "rock wool", "STRONG_COMPATIBLE"), ("clay", "sandstone", "CONTRADICTION"), ("steel", "mild steel pipes", "EXACT_MATCH"), ("plastic", "GRP", "STRONG_COMPATIBLE"), ("oak", "steel", "UNKNOWN")],
)
def test_materials(spark, q, c, want):
    assert state(spark, C.material_state, q, c) == want


@pytest.mark.parametrize("q, c, want", [("check_valve", "swing check reflux valves", "STRONG_COMPATIBLE"), ("check valve", "pressure reducing valve", "CONTRADICTION"), ("gate", "gate valves", "EXACT_MATCH"), ("pressure reducing", "non-return valve", "CONTRADICTION"), ("ball", "tile", "UNKNOWN")])
def test_subtypes(spark, q, c, want):
    assert state(spark, C.subtype_state, q, c) == want


@pytest.mark.parametrize("q, c, want", [("fly ash", "with calcined clay", "CONTRADICTION"), ("fly ash", "fly ash based", "EXACT_MATCH"), ("calcined clay", "fly ash based", "CONTRADICTION")])
def test_pozzolana(spark, q, c, want):
    assert state(spark, C.pozzolana_state, q, c) == want


@pytest.mark.parametrize("t, text, want", [(600.0, "up to 650 C", (4.0, "TEMPERATURE_MATCH")), (600.0, "up to 450 C", (-8.0, "TEMPERATURE_CONTRADICTION")), (5.0, "from 10 to -2", (0.0, "TEMPERATURE_UNKNOWN")), (50.0, "60 to 40 degrees C", (4.0, "TEMPERATURE_MATCH")), (None, "up to 1 C", (0.0, None))])
def test_temperature(spark, t, text, want):
    row = spark.createDataFrame([(t, text)], "t double, x string").select(*C.temperature(F.col("t"), F.col("x"))).first()
    assert tuple(row) == want


@pytest.mark.parametrize("g, text, want", [("43", "Ordinary cement, 43 grade", "GRADE_MATCH"), ("43", "53 grade cement", "GRADE_CONTRADICTION"), ("B", "tiles of grade A", "GRADE_CONTRADICTION"), ("43", "cement", "GRADE_UNKNOWN")])
def test_grade(spark, g, text, want):
    assert spark.createDataFrame([(g, text)], "g string, x string").select(*C.grade(F.col("g"), F.col("x"))).first()[1] == want


@pytest.mark.parametrize("q, c, fq, fc, want", [("valve", "valve", "v", "v", "compatible"), ("valve", "pipe", "v", "p", "incompatible"), (None, "pipe", None, "p", "unknown_query_product"), ("pipe", "pipe_fitting", "p", "p", "adjacent"), ("x", "y", None, None, "same_family")])
def test_compatibility(spark, q, c, fq, fc, want):
    row = spark.createDataFrame([(q, c, fq, fc)], "q string, c string, fq string, fc string")
    assert row.select(C.compatibility(*map(F.col, ("q", "c", "fq", "fc")))).first()[0] == want


def test_scores_gate_and_orders(spark):
    schema = "query_id long, doc_id string, rank long, rrf_score double, product string, family string, applies_to array<string>, title string, scope string, material string, q_product string, q_family string, q_material array<string>, q_excluded_material array<string>, q_grade string, q_temperature_c double"
    intent = ("valve", "valves", ["steel"], ["clay"], None, None)
    rows = spark.createDataFrame(
        [
            (1, "pipe", 1, 0.03, "pipe", "pipes", None, "Clay pipes", "", None, *intent),
            (1, "valve", 2, 0.02, "valve", "valves", None, "Valves", "of steel", None, *intent),
            (1, "none", 3, 0.01, None, None, None, "", None, None, *intent),
        ],
        schema,
    )
    scored = C.score(rows)
    got = {r.doc_id: (r.constraint_score, r.flags) for r in scored.collect()}
    assert got["valve"] == (12.0, ["PRODUCT_EXACT_PRODUCT", "MATERIAL_EXACT_MATCH", "EXCLUDED_MATERIAL_CLEAR"])
    assert got["pipe"] == (-26.0, ["PRODUCT_CONTRADICTION", "MATERIAL_CONTRADICTION", "EXCLUDED_MATERIAL_CONTRADICTION"])
    assert got["none"] == (0.0, ["PRODUCT_UNKNOWN", "MATERIAL_UNKNOWN", "EXCLUDED_MATERIAL_CLEAR"])
    fit = C.compatibility(*map(F.col, ("q_product", "product", "q_family", "family")))
    by = lambda df, c: [r.doc_id for r in df.orderBy(c).collect()]
    assert by(C.gate(rows, fit), "gated_rank") == ["valve", "none", "pipe"]
    assert by(C.order(scored), "constraint_rank") == ["valve", "none", "pipe"] == by(C.final_order(scored), "final_rank")


def test_texts_are_read_before_they_meet(spark):
    """What is told of a text is told once a document, below the join, and is worth the same."""
    docs = spark.createDataFrame([(1, "pipe", "made of HDPE", "up to 60 degrees C", "pipes of 43 grade"), (2, "pipe", "brass", None, ""), (3, None, None, None, " ")], "doc_id int, product string, material string, scope string, title string")
    wants = spark.createDataFrame([(1, "pipe", ["HDPE", "", None], ["brass"], "43", 50.0), (2, "valve", [], None, "53", None), (3, None, None, ["plastic"], None, 70.0)], "query_id int, q_product string, q_material array<string>, q_excluded_material array<string>, q_grade string, q_temperature_c double")
    apart = C.score(C.asked(wants).crossJoin(C.prepared(docs)))
    above = apart._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "regexp" not in above.lower()
    rows = lambda df: sorted((r.query_id, r.doc_id, r.constraint_score, r.flags) for r in df.collect())
    assert rows(apart) == rows(C.score(wants.crossJoin(docs))) and len(rows(apart)) == 9
    assert apart.columns == [*wants.columns, *docs.columns, "constraint_score", "flags"]
    first = rows(apart)[0]
    assert first[2] == 8 + 4 + 4 + 4 and first[3] == ["PRODUCT_EXACT_PRODUCT", "MATERIAL_EXACT_MATCH", "EXCLUDED_MATERIAL_CLEAR", "GRADE_MATCH", "TEMPERATURE_MATCH"]
