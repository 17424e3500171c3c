import random

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import corpus, facts, joins, retrieval


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "expr, value, want",
    [
        (T.canonical_id, " is  16910 (Part 1) : 2020 ", "IS 16910 (PART 1):2020"),
        (T.base_code, "IS 16910 (PART 1):2020", "IS 16910"),
        (T.base_code, "IS 1:2000", "IS 1:2000"),
        (T.token_key, "Non-return_valve, 2\"", "non return valve 2"),
        (T.dash_key, "A_b-c/d. E", "a b c d. e"),
        (T.underscore_key, "A_b-c", "a b-c"),
        (T.audit_key, "..A--b!", "a b"),
        (T.compact_code, "is 1 2", "IS12"),
        (lambda c: T.excerpt(c, 8), "abcde fghij", "abcde..."),
        (T.clean, "  ", None),
    ],
)
def test_text_keys(spark, expr, value, want):
    assert one(spark, value, expr) == want


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "clay roof ridge tile"), (2, "clay roof tile"), (3, "UPVC borewell casing pipe")], "d long, t string")
    queries = spark.createDataFrame([(0, "ridge clay tile")], "q long, t string")
    got = retrieval.Bm25Index(docs, "d", "t", queries, "q", "t").search(2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].score > got[1].score


def ranked(spark, ids):
    return spark.createDataFrame([(0, d, i) for i, d in enumerate(ids, 1)], "query_id long, doc_id string, rank long")


def test_rrf(spark):
    got = retrieval.rrf(ranked(spark, "ABC"), ranked(spark, "BD")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["B", "A", "D", "C"]
    assert got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    assert [r.rank for r in got] == [1, 2, 3, 4]


def test_rerank_ties_and_repeats(spark):
    rows = spark.createDataFrame([(0, "a", 2, 0.5), (0, "b", 1, 0.5), (0, "b", 3, 0.5), (0, "c", 4, 0.9)], "query_id long, doc_id string, rrf_rank long, s double")
    got = retrieval.rerank(rows, F.col("s"), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in got] == [("c", 1), ("b", 2), ("a", 3)]


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 7), (3, 15), (4, None)], "query_id long, rank long")
    r = retrieval.retrieval_metrics(ranks).first()
    assert (r.hit1, r.hit5, r.hit10, r.recall20) == (1, 1, 2, 0.75)
    assert r.mrr == pytest.approx((1 + 1 / 7 + 1 / 15) / 4, abs=1e-6)


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 0.95])
def test_jaccard_pairs_of_near_copies_equal_brute_force(spark, least):
    """Sizes on both sides of the border between the two ways to meet, copies, and sets with a token more or less."""
    r = random.Random(7)
    base = [[r.randrange(60) for _ in range(n)] for n in (1, 2, 3, 5, 8, 10, 10, 12, 15, 16, 17, 18, 20, 26)]
    sets = [set(b) for b in base for _ in range(2)]
    for b in base:
        for _ in range(6):
            x = set(b)
            for _ in range(r.randrange(4)):
                x ^= {r.randrange(60)}
            sets.append(x)
    rows = [(i, ["t%d" % t for t in s]) for i, s in enumerate(sets)] + [(999, [])]
    got = {(x.a, x.b): x.jaccard for x in joins.jaccard_pairs(spark.createDataFrame(rows, "id long, s array<string>"), least).collect()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = {(i, j): round(alike(sets[i], sets[j]), 6) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j]) >= least - 1e-9}
    assert got == pytest.approx(want)


def test_jaccard_pairs_equal_brute_force(spark):
    sets = {i: {chr(97 + (i * j + j * j) % 11) for j in range(1, 3 + i % 6)} for i in range(40)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<string>")
    got = {(r.a, r.b) for r in joins.jaccard_pairs(rows, 0.6).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_audit(spark):
    schema = "source_index long, code string, key string, title string, scope string, full_text string, page_start int, page_end int"
    rows = spark.createDataFrame([(1, "c", "k", "t", "s", "x" * 100, 2, 1), (2, " ", None, "", None, "short", 1, 1)], schema)
    got = {(r.source_index, r.issue_type) for r in corpus.audit_issues(rows, "zzz").collect()}
    assert got == {(1, "invalid_page_range"), (2, "missing_code"), (2, "missing_key"), (2, "missing_title"), (2, "missing_scope"), (2, "short_record")}


def test_canonical_takes_best_then_first(spark):
    rows = spark.createDataFrame([("k", 3, 5, "a", "t"), ("k", 1, 5, "b", "t"), ("k", 2, 4, "a", "t"), ("j", 4, 1, "a", "t")], "key string, i long, s long, title string, full_text string")
    got = {r.key: (r.source_index, r.source_record_count, r.conflicting) for r in corpus.canonical(rows, "key", F.col("s"), "i").collect()}
    assert got == {"k": (1, 3, True), "j": (4, 1, False)}


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, None), (4, "d")], "k long, v string")
    once = corpus.upsert(old, new, "k", ["v"])
    assert {(r.k, r.change, r.v) for r in once.collect()} == {(1, "kept", "a"), (2, "updated", None), (3, "unchanged", None), (4, "inserted", "d")}
    again = corpus.upsert(once.select("k", "v"), new, "k", ["v"])
    assert {r.change for r in again.collect()} == {"kept", "unchanged"}


def test_graph(spark):
    rows = spark.createDataFrame([("a", "b", " normative ref ", 1, 1), ("a", "b", "Normative-Ref", 2, 2), ("a", "c", " ", 3, 3)], "src string, dst string, relation string, evidence long, at long")
    edges = corpus.graph_merge(rows, "at")
    assert [tuple(r) for r in edges.collect()] == [("a", "NORMATIVE_REF", "b", 2)]
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert {tuple(r) for r in corpus.allied(nodes, edges).collect()} == {("a", "NORMATIVE_REF", "b"), ("b", "NORMATIVE_REF", "a"), ("z", None, None)}


def test_facts():
    found = facts.facts("Nominal size 150 x 150 x 15 mm is usual. " + "y " * 80 + "Tolerance of 2 mm. " + "y " * 80 + "up to 650 C")
    assert [(f["kind"], f["value"]) for f in found] == [("size", "150 × 150 × 15 mm"), ("temperature", "650 C")]
    assert facts.facts(None) == []


def test_summary_and_scope(spark):
    text = "Title AND\nSUMMARY OF\n  REDUCERS FOR\nPVC PIPES\n1. Scope - Covers the requirements of reducers.\n 2. Terms"
    assert one(spark, text, facts.summary_heading) == "REDUCERS FOR PVC PIPES"
    assert one(spark, text, facts.scope_text) == "Covers the requirements of reducers."


def test_round_robin(spark):
    rows = spark.createDataFrame([(i, "ab"[i > 3]) for i in range(6)], "i long, b string")
    assert [r.i for r in corpus.round_robin(rows, ["b"], ["i"], 4).orderBy("turn", "b").collect()] == [0, 4, 1, 5]


def test_search_and_requests(spark):
    from docsift import api

    docs = spark.createDataFrame([(1, "clay roof tile. It is red."), (2, "steel pipe 20 mm")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "roof tile")], "query_id long, text string")
    got = api.search(docs, queries).collect()
    assert [(r.doc_id, r.rank, r.score_source) for r in got] == [(1, 1, "rrf_fallback")]
    for limit, text in ((0, "x"), (31, "x"), (5, " ")):
        with pytest.raises(ValueError):
            api.search(docs, spark.createDataFrame([(0, text)], "query_id long, text string"), limit)
    assert api.analyze(docs).where("doc_id = 2").first().facts[0].value == "20 mm"


def test_near_dup_seq_finds_pairs_of_the_whole_table(spark, sf):
    import re
    from difflib import SequenceMatcher
    from itertools import combinations

    import duckdb

    from docsift.plans import registry

    part = duckdb.sql(f"SELECT p_partkey, 'need ' || p_name || ' size ' || p_size || ' of ' || p_brand || ' type ' || p_type AS q FROM '{sf}/part.parquet'").fetchall()
    grams = {i: set(re.findall("[a-z0-9]+", q.lower())) for i, q in part}
    text = {i: q.lower() for i, q in part}
    near = {(a, b) for a, b in combinations(sorted(grams), 2) if len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    want = {(a, b) for a, b in near if SequenceMatcher(None, text[a], text[b], autojunk=False).ratio() >= 0.94}
    got = {(r.a, r.b) for r in registry.queries()["near_dup_seq"](spark, sf).collect()}
    assert got == want and any(a % 20 and b % 20 for a, b in got)


def test_near_dup_seq_of_copies_grows_with_the_table(spark, sf, tmp_path):
    """Links between texts stay those of one copy; each further copy is one row."""
    from docsift.plans import registry

    part = spark.read.parquet(f"{sf}/part.parquet")
    n, keys = part.count(), spark.range(6).withColumnRenamed("id", "copy")
    part.crossJoin(keys).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * 1000000).drop("copy").write.parquet(str(tmp_path / "part.parquet"))
    found = registry.queries()["near_dup_seq"]
    one, six = ({(r.a, r.b, r.jaccard, r.ratio) for r in found(spark, d).collect()} for d in (sf, str(tmp_path)))
    assert one <= six and len(six) == len(one) + 5 * n
    assert all(jaccard == ratio == 1.0 and a % 1000000 <= b % 1000000 for a, b, jaccard, ratio in six - one)


def test_sequence_ratio_is_that_of_sequence_matcher():
    import random
    from difflib import SequenceMatcher

    from docsift.operators import joins

    draw = random.Random(5)
    for n in range(6000):
        letters = draw.choice(["a", "ab", "abc", "abcdefgh "])
        some = lambda most: "".join(draw.choice(letters) for _ in range(draw.randrange(most)))  # noqa: B023, E731
        head, tail = (some(25), some(25)) if n % 3 else ("", "")
        a, b, least = head + some(9) + tail, head + some(9) + tail, draw.random()
        want, got = SequenceMatcher(None, a, b).ratio(), joins._ratio(a, b, least)
        assert got == want or got is None and want < least, (a, b)
    a, b = "x y" * 90, "x z" * 90
    assert joins._ratio(a, b) == SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("chars", [None, 0])
def test_text_pairs_are_all_pairs_and_few_are_read(spark, monkeypatch, chars):
    """Of short and long texts, broadcast or joined; what letters rule out is not compared, and pairs are dealt by number."""
    import random
    import re
    from difflib import SequenceMatcher
    from itertools import combinations

    from docsift.functions import text as X
    from docsift.operators import joins

    if chars is not None:
        monkeypatch.setattr(joins, "BROADCAST_CHARS", chars)
    draw, texts = random.Random(3), {"", "!", "éa éb"}
    for _ in range(60):
        words = ["".join(draw.choice("abcdeo") for _ in range(draw.randrange(1, 6))) for _ in range(draw.choice([3, 9, 12, 18, 24]))]
        for _ in range(5):
            words[draw.randrange(len(words))] = draw.choice(["abc", "ab", "cab", "7", "71"])
            texts.add(" ".join(words))
    rows = dict(enumerate(sorted(texts)))
    sets = {i: set(re.findall("[a-z0-9]+", t)) for i, t in rows.items()}
    alike = {(i, j) for i, j in combinations(rows, 2) if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    want = {(i, j): round(r, 6) for i, j in alike if (r := SequenceMatcher(None, rows[i], rows[j]).ratio()) >= 0.9}
    table = spark.createDataFrame(list(rows.items()), "id long, text string").withColumn("s", F.array_distinct(X.tokens(F.col("text"))))
    assert {(r.a, r.b): r.ratio for r in joins.text_pairs(table, 0.7, 0.9).collect()} == want and len(want) > 50
    few = joins.candidates(table, 0.7, 0.9)
    assert len(want) <= few.count() < joins.candidates(table, 0.7).count()
    assert few.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
