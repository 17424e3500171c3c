"""Search that heeds what a requirement wants and what it excludes."""

from docsift import api


def test_product_search(spark):
    docs = spark.createDataFrame(
        [
            (1, "steel pipe for water water water", "steel pipe", "s", "pipe", "piping", "steel", None),
            (2, "HDPE pipe for water", "HDPE pipe", "s", "pipe", "piping", "HDPE", None),
            (3, "HDPE pump for water", "HDPE pump", "s", "pump", "pumps", "HDPE", None),
            (4, "roof tiles", "roof tiles", "s", "tile", "roofing", "clay", None),
        ],
        "doc_id long, text string, title string, scope string, product string, family string, material string, application string",
    )
    queries = spark.createDataFrame([(7, "HDPE pipe for water, not steel"), (8, "water")], "query_id long, text string")
    vocabulary = spark.createDataFrame([("material", "HDPE", "hdpe", 0), ("material", "steel", "steel", 1), ("product", "pipe", "pipe", 0)], "field string, value string, phrase string, ord int")
    families = spark.createDataFrame([("pipe", "piping"), ("pump", "pumps")], "product string, family string")
    rows = api.product_search(docs, queries, vocabulary, families).orderBy("query_id", "rank").collect()
    first = [r for r in rows if r.query_id == 7]
    assert [r.doc_id for r in first][0] == 2 and {r.doc_id for r in first} == {1, 2, 3}
    assert first[0].constraint_score > 0 > max(r.constraint_score for r in first[1:])
    assert {r.doc_id: r.compatibility for r in first} == {1: "compatible", 2: "compatible", 3: "incompatible"}
    assert any(f.startswith("EXCLUDED_MATERIAL_CONTRADICTION") for r in first if r.doc_id == 1 for f in r.flags)
    assert {r.doc_id for r in rows if r.query_id == 8} == {1, 2, 3} and all(r.constraint_score == 0 for r in rows if r.query_id == 8)


DOCS = "doc_id long, text string, standard_id string, title string, scope_text string, retrieval_text string, canonical_product string, family string, product_subtype string, material string, application string, function string, primary_subject string, applies_to array<string>"


def stored(i, text, product=None, family=None, title=None, applies=()):
    return (i, text, f"s{i}", title or text, None, None, product, family, None, None, None, None, None, list(applies))


def test_recommend_and_trace(spark):
    docs = spark.createDataFrame(
        [
            stored(1, "reflux valves for water lines", "fitting", "fittings"), stored(2, "pumps for water water", "pump", "pumps", applies=["water_valve"]), stored(3, "water meter for a valve", "meter", "meters"),
            stored(4, "water tanks", "tank", "tanks"), stored(5, "water", None, None), stored(6, None),
        ],
        DOCS,
    )
    queries = spark.createDataFrame([(1, "valve for water, must not let water come back"), (2, "water")], "query_id long, text string")
    vocabulary = spark.createDataFrame([("product", "valve", "valve", 0), ("medium", "water", "water", 0)], "field string, value string, phrase string, ord int")
    families = spark.createDataFrame([("valve", "water_valve")], "product string, family string")
    rows = api.recommend(docs, queries, vocabulary, families, limit=5).collect()
    first = {r.doc_id: r for r in rows if r.query_id == 1}
    assert first[1].rank == 1 and first[1].compatibility == "compatible" and first[1].metadata.canonical_product == ("fitting", "valve")
    assert first[2].compatibility == "applies_to_family" and first[3].compatibility == "compatible" and first[4].compatibility == "incompatible" and first[5].compatibility == "unknown_candidate_product"
    assert first[1].match_summary[:2] == ["product_compatibility=compatible", f"constraint_score={first[1].constraint_score:g}"] and first[1].match_summary[-1] == "score_source=rrf_fallback"
    assert 6 not in first and {r.compatibility for r in rows if r.query_id == 2} == {"unknown_query_product"}
    traced = {r.query_id: r for r in api.recommend(docs, queries, vocabulary, families, traced=True).collect()}
    assert len(traced[1].pool) == 5 and traced[1].semantic_top is None and [x.doc_id for x in traced[1].final_top] == [r.doc_id for r in sorted(first.values(), key=lambda r: r.rank)]
    assert {x.doc_id: x.metadata.function.effective for x in traced[1].pool}[1] == "prevent_reverse_flow"
    assert api.recommend(docs.limit(0), queries, vocabulary, families).count() == 0
