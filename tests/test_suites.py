"""Suite evaluation by hand, with cases that a system does not answer."""

from docsift.operators import suites


def test_rates_misses_and_presence(spark):
    results = spark.createDataFrame(
        [("a", 1, 10, 1, "compatible", False), ("a", 1, 11, 2, "incompatible", True), ("a", 2, 10, 1, "incompatible", False), ("a", 2, 12, 2, "compatible", False), ("b", 1, 11, 1, "incompatible", True), ("b", 1, 10, 7, "compatible", False), ("c", 1, 10, 1, "compatible", False)],
        "system string, query_id int, doc_id int, rank long, compatibility string, contradicts boolean",
    )
    cases = spark.createDataFrame([(1, "s", "f", 10), (2, "s", "g", 12), (3, "t", None, None)], "query_id int, suite string, family string, expected int")
    rows = suites.case_rows(results, cases, ["a", "b"])
    assert rows.count() == 6
    got = {(r.system, r.suite, r.family, r.level): r for r in suites.evaluate(rows).collect()}
    assert {k[0] for k in got} == {"a", "b"} and len(got) == 12
    a, b = got["a", None, None, 0], got["b", None, None, 0]
    assert (a.cases, a.hit1, a.hit3, a.recall5, a.mrr, a.found) == (3, 1, 2, 0.666667, 0.5, 0.666667)
    assert (a.cross_product_errors, a.contradictions, b.cross_product_errors, b.contradiction_rate) == (1, 1, 1, 0.333333)
    assert got["b", "t", None, 2].found == 0 and got["b", "t", None, 1].cases == 1 and got["b", "s", "f", 2].mrr == round(1 / 7, 6)
    watched = spark.createDataFrame([(1, 10), (2, 10), (9, 9)], "query_id int, doc_id int")
    assert {tuple(r) for r in suites.presence(results, watched, ["a", "b"], 5).collect()} == {(1, 10, 1, None), (2, 10, 1, None), (9, 9, None, None)}
    kept = {r.suite: r for r in suites.preserved(rows, "b", "a").collect()}
    assert (kept["s"].fixed, kept["s"].lost, kept["s"].kept, kept["s"].keep) == (1, 0, 0, True) and kept["t"].missed == 1 and not kept["t"].keep
    assert suites.evaluate(suites.case_rows(results, cases.limit(0), ["a"])).count() == 0
