from pyspark.sql import functions as F

from docsift.operators import intent, metadata, phrases


def tables(spark):
    aliases = spark.createDataFrame([("pipe", "pipe", 1), ("pipe", "pipes", 1), ("pipe_fitting", "reducer", 2), ("pipe_fitting", "reducers", 2), ("cement", "cement", 3), ("cement", "hydraulic cement", 3)], "product string, phrase string, ord int")
    families = spark.createDataFrame([("pipe", "pipes"), ("pipe_fitting", "pipes"), ("cement", "cement")], "product string, family string")
    patterns = spark.createDataFrame(
        [("material", "PVC", "pvc", 1, False), ("material", "steel", "steel", 2, False), ("application", "potable water supply", "potable water", 1, False), ("subtype", "reducer", "reducers", 1, True)],
        "field string, value string, phrase string, ord int, headings_only boolean",
    )
    return aliases, families, patterns


def test_derive(spark):
    schema = "id long, title string, scope string, summary string, full_text string"
    rows = [
        (1, "REDUCERS FOR", "Covers reducers of PVC", "REDUCERS FOR PVC PIPES", "steel pipe pipe potable water"),
        (2, "METHODS OF TEST FOR HYDRAULIC CEMENT", None, None, None),
        (3, "Specification for brass door handle 12", "x", None, "reducers"),
        (4, None, None, None, None),
    ]
    got = {r.id: r for r in metadata.derive(spark.createDataFrame(rows, schema), *tables(spark), ["specification", "for"]).collect()}
    a, b, c, d = (got[i] for i in (1, 2, 3, 4))
    assert (a.product, a.confidence, a.family, a.material, a.application, a.subtype) == ("pipe_fitting", "high", "pipes", "PVC", "potable water supply", "reducer")
    assert (b.standard_kind, b.product, b.family, b.applies_to, b.confidence, b.review_required) == ("test_method", None, None, ["cement"], "high", False)
    assert (c.product, c.confidence, c.subtype) == ("pipe_fitting", "low", None) and c.review_required
    assert (d.product, d.confidence, d.standard_kind) == (None, "low", "other")


def test_large_taxonomy_gives_the_same_hits(spark, monkeypatch):
    aliases, _, _ = tables(spark)
    sources = spark.createDataFrame([(1, "title", "a hydraulic cement pipe"), (2, "scope", "pipes cementing")], "id long, source string, norm string")
    hits = lambda: sorted(map(tuple, metadata.phrase_hits(sources, aliases).select("id", "phrase").collect()))
    want = [(1, "cement"), (1, "hydraulic cement"), (1, "pipe"), (2, "pipes")]
    assert hits() == want
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 2)
    assert hits() == want


def test_fallback(spark):
    rows = spark.createDataFrame([("Specification for heavy brass door handle 12",), ("12",)], "t string")
    assert [r[0] for r in rows.select(metadata.fallback_product(F.col("t"), ["for"])).collect()] == ["heavy_brass_door_handle", None]


def test_intents(spark):
    vocabulary = spark.createDataFrame(
        [("application", "flooring", "floor", 1), ("application", "roofing", "roof", 2), ("material", "steel", "ms", 1), ("material", "clay", "clay", 2)], "field string, value string, phrase string, ord int"
    )
    queries = spark.createDataFrame([(1, "tile for interior flooring, not roofing, of clay"), (2, "valve on MS water line"), (3, "43 grade cement up to 60 c"), (4, "")], "query_id long, text string")
    got = {r.query_id: r for r in intent.intents(queries, vocabulary).collect()}
    assert got[1].q_application == ["flooring"] and got[1].q_excluded_application == ["roofing"] and got[1].q_material == ["clay"]
    assert got[2].q_material == [] and got[2].context_material == ["steel"]
    assert (got[3].q_grade, got[3].q_temperature_c) == ("CEMENT", 60.0)
    assert got[4].q_grade is None and got[4].q_material == []


def test_items(spark):
    docs = spark.createDataFrame([(1, "Item 1: steel pipe. Item 2: clay tile. Item 3: brass valve"), (2, "Supply:\n1. pipe\n2. tile"), (3, "one thing"), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.item, r.text) for r in intent.items(docs).orderBy("doc_id", "item").collect()]
    assert got == [(1, 1, "Item 1: steel pipe."), (1, 2, "Item 2: clay tile."), (1, 3, "Item 3: brass valve"), (2, 1, "Supply:"), (2, 2, "1. pipe"), (2, 3, "2. tile"), (3, 1, "one thing")]


def test_scrub_and_templates(spark):
    rows = spark.createDataFrame([(1, "pipe", "see IS 1239 (Part 1): 2004 too"), (2, "pipe", None)], "doc_id long, p string, s string")
    assert rows.select(intent.scrub(F.col("s"))).first()[0] == "see too"
    got = intent.templates(rows, [F.concat(F.lit("need "), "p"), F.col("s"), F.concat_ws(" ", F.lit("buy"), "p", F.col("doc_id").cast("string"))]).collect()
    assert sorted((r.doc_id, r.query) for r in got) == [(1, "buy pipe 1"), (1, "need pipe"), (2, "buy pipe 2")]
