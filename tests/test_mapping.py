"""Row mappings, phrases, parameter groups, scores and guards on hand-written rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docsift.operators import guards, mapping


def test_curated(spark):
    schema = "standard_code string, record_id string, title string, source_scope string, lifecycle_status string, lifecycle_status_note string, source_revision string, source_page_start int, source_page_end int, retrieval_text string, full_text string, product_family array<string>, applications array<string>, materials array<string>"
    rows = [
        ("is 4985 (part 2) sec 3 : 2000", "r1", "t", "s", None, None, None, 1, 2, " A  b ", "f", ["Pipes", " "], ["Water  supply", "pipes"], None),
        (None, "r2", None, None, "", None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    out = mapping.curated(df, "d")
    assert len(out.columns) == 22
    a, b = sorted(out.collect(), key=lambda r: r.source_record_id)
    assert (a.canonical_id, a.base_code, a.part, a.section, a.publication_year, a.status) == ("IS 4985 (PART 2) SEC 3:2000", "IS 4985", "2", "3", 2000, "UNKNOWN")
    assert a.keywords == ["pipes", "water supply"] and a.normalized_retrieval_text == "a b" and a.search_profile.materials == []
    assert (b.canonical_id, b.status, b.keywords) == (None, "UNKNOWN", [])
    assert [r.product for r in mapping.preview(df).collect()] == ["Pipes,  ", ""] and mapping.preview(df).first().standard_code == "IS 4985 (PART 2) SEC 3: 2000"


def test_whole_corpus(spark):
    text = ["standard_code", "standard_code_norm", "title", "scope", "revision", "retrieval_text", "full_text", "product_derivation_source", "quality_flags"] + [k for k in mapping.KEPT if k not in mapping.KEYWORD_LISTS]
    row = dict.fromkeys(text) | {"standard_code": "IS 5:1990", "standard_code_norm": "IS 55:1990", "revision": "second 1988 rev:1990 x", "material": "clay", "family": "", "canonical_product": "tile", "title": ""}
    row |= {"page_start": 1, "page_end": 2, "product_aliases": ["tiles", ""], "applies_to_product_families": None}
    schema = ", ".join(f"{k} string" for k in text) + ", page_start int, page_end int, product_aliases array<string>, applies_to_product_families array<string>"
    out = mapping.whole_corpus(spark.createDataFrame([row], schema), "d")
    r = out.first()
    assert (r.title, r.base_code, r.publication_year, r.status, r.keywords) == ("IS 5:1990", "IS 55", 1990, "SOURCE_PARSED", ["tile", "clay", "tiles"])
    assert len(out.columns) == 49 and r.search_profile.material == "clay"
    assert len(set(out.columns)) == 49


def test_changes_and_phrases(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', cast(null as string)) AS o, named_struct('a', 1, 'b', x) AS n FROM VALUES (cast(null as string)), ('y') AS t(x)")
    assert sorted(r.c for r in df.select(mapping.has_changes("o", "n", ["a", "b"]).alias("c")).collect()) == [False, True]
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(mapping.scope_phrase(F.lit(" Covers \n tiles.."))) == "Covers tiles"
    assert len(one(mapping.scope_phrase(F.lit("ab " * 200)))) <= 220 and one(mapping.scope_phrase(F.lit(None).cast("string"))) == ""
    assert one(mapping.title_phrase(F.lit(""), F.lit("IS 5 A B C D"))) == "is 5 a b c"
    assert one(mapping.product_description(F.lit("Covers tiles."), F.lit("Roof TILES"))) == "Covers tiles (roof tiles)"


def test_parameter_groups_and_scores(spark):
    names = ["classifier.weight", "encoder.layer.0.x", "encoder.layer.2.x", "encoder.layer.5.x", "layers.1.y", "embed"]
    got = {r.name: r.group for r in mapping.parameter_groups(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {
        "classifier.weight": "classification_or_scoring_head", "encoder.layer.0.x": "early_frozen_transformer_layer", "encoder.layer.2.x": "fourth_from_last_transformer_layer",
        "encoder.layer.5.x": "final_transformer_layer", "layers.1.y": None, "embed": None,
    }
    assert [r.group for r in mapping.parameter_groups(spark.createDataFrame([("embed",)], "name string")).collect()] == [None]
    rows = spark.createDataFrame([("q", 2, [0.5, 9.0]), ("q", 1, [0.25])], "g string, i int, s array<double>")
    assert mapping.by_group(mapping.scored(rows, F.col("s")), "g", "i").first().scores == [0.25, 0.5]
    assert mapping.scored(spark.range(1), F.lit("1.5")).first().score == 1.5
    with pytest.raises(PySparkException, match="must not be empty"):
        mapping.scored(spark.createDataFrame([([],)], "s array<double>"), F.col("s")).collect()


def test_guards(spark, tmp_path):
    assert guards.count_or_null(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert guards.count_or_null(spark, str(tmp_path / "t")) == 3
    assert guards.neighbours_or_none(lambda: spark.range(3), 2) == ([{"id": 0}, {"id": 1}], None)
    assert guards.neighbours_or_none(lambda: spark.table("no_such_graph"), 2) == ([], "graph unavailable")
    with pytest.raises(ValueError):
        guards.degrade(lambda: int("x"), 0, "w")
