"""Titles, retrieval texts, flags and ambiguous products at their edges."""

from pyspark.sql import functions as F

from docsift.operators import texts


def test_titles(spark):
    rows = [("Pipes", "Pipes of steel", "Pipes of steel"), ("Pipes", "Pipes a", None), ("PIPES FOR", "x", "x"), ("pipes for", "x", None), ("Pipes,", "y", "y"), ("TOFOR", "z", "z"), ("Non-return", "non return", None), (None, "x", None), ("a", None, None), ("", "x", None)]
    got = spark.createDataFrame(rows, "t string, s string, want string").select(texts.reconstructed_title(F.col("t"), F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_retrieval_text_of_nothing_names_the_kind(spark):
    none = F.lit(None).cast("string")
    text = texts.retrieval_text(*[none] * 11)
    assert spark.range(1).select(text).first()[0] == "TYPE: other"


def test_flags_of_nothing(spark):
    none = F.lit(None)
    flags = texts.quality_flags(*(none.cast("string") for _ in range(5)), none.cast("boolean"), none.cast("int"))
    assert spark.range(1).select(flags).first()[0] == ["missing_title", "missing_scope", "missing_full_text", "missing_primary_subject"]


def test_ambiguous(spark):
    rows = [(i, f"c{9 - i}", "pipe", None, "f", None) for i in range(10)] + [(20, "x", None, "", "only", False), (21, "y", None, None, None, False), (22, "z", "valve", None, None, True), (23, "w", "valve", None, None, False)]
    got = texts.ambiguous(spark.createDataFrame(rows, "place int, code string, product string, subtype string, family string, review boolean")).collect()
    assert [(r.key, r.query, r.plausible) for r in got] == [("pipe", "Need pipe standard", [f"c{i}" for i in range(2, 10)])]
