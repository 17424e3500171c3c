import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsift.operators import evaluation as E
from docsift.operators import negatives as N
from docsift.operators import training as R


def test_losses(spark):
    rows = spark.createDataFrame([(1, 3.0), (0, -3.0), (1, -1.0), (0, 1.0)], "y int, x double")
    loss, acc = rows.agg(E.bce(F.col("x"), F.col("y")), E.accuracy(F.col("x"), F.col("y"))).first()
    want = [math.log1p(math.exp(-3)), math.log1p(math.exp(-3)), math.log1p(math.exp(1)), math.log1p(math.exp(1))]
    assert loss == pytest.approx(sum(want) / 4) and acc == 0.5
    pairs = spark.createDataFrame([("q", 1, 0.9), ("q", 0, 0.1), ("r", 1, 0.2), ("r", 0, 0.8)], "query_id string, label int, score double")
    assert E.ranknet(pairs).first().loss == pytest.approx((math.log1p(math.exp(-0.8)) + math.log1p(math.exp(0.6))) / 2)


def test_pair_ranking(spark):
    rows = spark.createDataFrame([("q1", "a", 1, 0.9), ("q1", "b", 0, 0.1), ("q2", "a", 1, 0.2), ("q2", "b", 0, 0.8), ("q2", "c", 0, 0.6)], "query_id string, code string, label int, score double")
    r = E.pair_ranking(rows).first()
    assert (r.queries, r.hit1, r.hit3) == (2, 1, 2) and r.mrr == pytest.approx((1 + 1 / 3) / 2)


def test_nearest_percentile(spark):
    r = random.Random(3)
    values = {g: [r.uniform(-50, 50) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 11), ("d", 400))}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {x.g: x.percentile for x in E.nearest_percentile(rows, "v", "g", p, width=7.0).collect()}
        assert got == {g: sorted(vs)[round(p * (len(vs) - 1))] for g, vs in values.items()}


def ranked(spark, lists):
    return spark.createDataFrame([(q, d, i) for q, ds in lists.items() for i, d in enumerate(ds, 1)], "query_id int, doc_id string, rank int")


def test_rank_stability(spark):
    a, b = ranked(spark, {1: "abc", 2: "ab", 3: "a"}), ranked(spark, {1: "acb", 2: "ab", 3: "z"})
    r = E.rank_changes(a, b, (1, 3)).first()
    assert (r.queries, r.top1_changed, r.top3_changed) == (3, 1, 2)
    rho = {x.query_id: x.rho for x in E.spearman(a, b).collect()}
    assert rho == {1: pytest.approx(1 - 6 * 2 / (3 * 8)), 2: 1.0, 3: 0.0}


def test_checkpoint_and_modes(spark):
    epochs = spark.createDataFrame([(1, 0.9, 0.80, 0.1), (2, 0.9, 0.85, 0.3)], "epoch int, mrr double, hit1 double, loss double")
    assert E.best_checkpoint(epochs).first().epoch == 2
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "g string, v int")
    assert tuple(E.mode_consistency(rows, "g", "v").first()) == ("a", 2, 3, pytest.approx(2 / 3))
    one = spark.createDataFrame([(5.0,)], "v double")
    assert E.distribution(one, "v", []).first().sd == 0


def test_eligibility(spark):
    schema = "review boolean, flags array<string>, kind string, subject string, product string, subtype string, confidence string, grounded boolean"
    good = (False, [], "product_standard", "s", "p", None, "high", True)
    change = lambda i, v: good[:i] + (v,) + good[i + 1 :]
    rows = [good, change(0, True), change(1, ["merged_artifact"]), change(2, "test_method"), change(3, None), change(4, None), change(6, "low"), change(7, False)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(R.eligibility(*map(F.col, ("review", "flags", "kind", "subject", "product", "subtype", "confidence", "grounded")))).collect()]
    assert got == ["SAFE_FOR_TRAINING", "NEEDS_REVIEW", "UNSAFE_FLAGS", "SEARCH_ONLY_KIND", "NO_SUBJECT", "NO_PRODUCT", "LOW_CONFIDENCE", "NO_GROUNDING"]


def test_negatives_fill_their_quotas(spark):
    docs = spark.createDataFrame([(i, None, p, n, ["t", str(i)]) for i, (p, n) in enumerate([("a", ["x"]), ("a", ["x"]), ("a", ["y"]), ("a", ["y"]), ("b", ["x"]), ("b", ["z"]), ("c", ["z"])])], "doc_id int, family string, product string, near array<string>, toks array<string>")
    got = R.hard_negatives(docs.where("doc_id = 0").withColumn("query_id", F.lit("q")), docs, ["near"]).orderBy("place").collect()
    assert sorted(r.category for r in got) == ["close_variant", "same_product", "same_product", "trap"] and 0 not in {r.doc_id for r in got}


def plain_negatives(q, docs):
    """Every document scored, as the quotas say."""
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    scored = []
    for d in docs:
        if d[0] is None or d[0] == q[0]:
            continue
        same = any(q[i] is not None and q[i] == d[i] for i in (1, 2))
        kind = "same_product" if same else "close_variant" if any(alike(set(q[i] or []), set(d[i] or [])) >= 0.35 for i in (3, 4)) else "trap"
        scored.append((-math.floor((alike(set(q[5] or []), set(d[5] or [])) + N.BONUS[kind]) * 1e6 + 0.5), d[0], kind))
    scored.sort()
    first = [x for kind, n in N.QUOTA.items() for x in [s for s in scored if s[2] == kind][:n]]
    return [(d, kind, -s / 1e6) for s, d, kind in sorted(first) + [s for s in scored if s not in first]][:4]


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 500_000), (60, 40)])
def test_negatives_equal_all_pairs(spark, shard, block):
    r = random.Random(8)
    some = lambda n, v: [v[min(int(r.expovariate(0.2)), len(v) - 1)] for _ in range(n)]
    words = ["w%d" % i for i in range(60)]
    rows = [(i, r.choice(["p", "q", "r", None]), r.choice(["f", None, None]), some(r.randrange(3), "abcdef"), r.choice([None, some(2, "xyz")]), some(r.randrange(1, 9), words)) for i in range(150)]
    rows += [(200 + i, "p", None, ["a"], None, ["w0", "w1", "w2"]) for i in range(60)] + [(300, None, None, None, None, None), (301, None, None, [], [], []), (302, "lone", None, [], [], ["nowhere"]), (None, "p", None, [], [], ["w0"])]
    docs = spark.createDataFrame(rows, "doc_id int, product string, family string, near array<string>, use array<string>, toks array<string>").repartition(3)
    queries = docs.where("doc_id % 20 = 0 or doc_id > 300").withColumn("query_id", F.col("doc_id"))
    got = {}
    for x in R.hard_negatives(queries, docs, ["near", "use"], shard_words=shard, block_words=block).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append((x.doc_id, x.category, x.score))
    assert got == {q[0]: plain_negatives(q, rows) for q in rows if q[0] is not None and (q[0] % 20 == 0 or q[0] > 300)}
    assert R.hard_negatives(queries.limit(0), docs, ["near"]).count() == 0 == R.hard_negatives(queries, docs.limit(0), ["near"]).count()


def test_the_threshold_spares_documents():
    r = random.Random(9)
    rows = [{"doc_id": i, "product": "p%d" % (i % 3), "family": None, "near": ["n%d" % (i % 5)], "toks": ["common", "often%d" % (i % 4), *("w%d" % r.randrange(3000) for _ in range(8))]} for i in range(5000)]
    rows += [{"doc_id": 9000 + i, "product": "p%d" % (i % 3), "family": None, "near": ["n%d" % (i % 5)], "toks": rows[0]["toks"][:-1]} for i in range(60)]
    kind = pa.schema([("doc_id", pa.int64()), ("product", pa.string()), ("family", pa.string()), ("near", pa.list_(pa.string())), ("toks", pa.list_(pa.string()))])
    shard = N.Shard(pa.Table.from_pylist(rows, kind), ["near"])
    best = [[], [], []]
    assert shard.search((0, 0, "p0", None, [["n0"]], rows[0]["toks"]), best, 4) < 200 and all(len(b) == 4 for b in best)


def test_split_and_leakage(spark):
    ids = spark.range(4000)
    once, again = R.split(ids, "id"), R.split(ids.repartition(7).where("id % 2 = 0"), "id")
    share = once.where("split = 'validation'").count() / 4000
    assert 0.12 < share < 0.18 and again.join(once, ["id", "split"]).count() == 2000
    train = spark.createDataFrame([(1, "Need cement  for finishing work."), (2, "need cement for some finishing work on a very long wall here now"), (3, "pipe")], "id int, text string")
    frozen = spark.createDataFrame([(1, "need cement for finishing work."), (2, "we need cement for some finishing work on a very long wall here now")], "id int, text string")
    assert sorted(map(tuple, R.leakage(train, frozen).collect())) == [(1, 1, "exact"), (2, 2, "near")]


def test_pair_violations(spark):
    pairs = spark.createDataFrame([("a", "q", 1, 1), ("a", "q", 2, 0), ("b", "q", 1, 1), ("c", "q", 1, 1), ("c", "r", 1, 0), ("d", "q", 9, 0)], "query_id string, query string, doc_id int, label int")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    got = {tuple(r) for r in R.pair_violations(pairs, docs).collect()}
    assert got == {("no_negatives", "b"), ("query_mismatch", "c"), ("duplicate_pair", "c"), ("positive_as_negative", "c"), ("not_one_positive", "d"), ("missing_document", "d")}


def test_hard_negatives_of_copies_search_classes(spark):
    """Six kinds of documents, forty copies each: a task sees five of each kind, and every query leaves out its own."""
    from docsift.operators import negatives

    docs = spark.range(240).selectExpr("id AS doc_id", "concat('p', id % 2) AS product", "CAST(NULL AS STRING) AS family", "array(concat('n', id % 3)) AS near", "split(concat('a b c ', id % 6), ' ') AS toks").repartition(3)
    assert negatives.first_of_classes(docs, ["near"], 5).count() == 30
    got = R.hard_negatives(docs.where("doc_id % 20 = 0").withColumn("query_id", F.col("doc_id")), docs, ["near"]).orderBy("query_id", "place").collect()
    for q in range(0, 240, 20):
        alike = [d for d in range(240) if d % 6 == q % 6 and d != q][:4]
        close = next(d for d in range(240) if d % 2 != q % 2 and d % 3 == q % 3)
        trap = next(d for d in range(240) if d % 2 != q % 2 and d % 3 != q % 3)
        assert [r.doc_id for r in got if r.query_id == q] == [*alike[:2], close, trap]


def test_relevance_shuffles_no_text(spark, monkeypatch):
    """However many documents hold a key of an item, their texts are compared where they lie."""
    from docsift.operators import retrieval as R
    from docsift.plans import retrieval as P

    def written():
        new, array = spark._jvm.java.util.ArrayList, spark.sparkContext._gateway.new_array
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(new(), False, False, array(spark._jvm.double, 0), new())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    monkeypatch.setattr(R, "few", lambda df, *_, **__: df)  # pairs of an item and a document as many as not to be broadcast
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, found = written(), P._relevant(spark, "/root/testdata/sf0.01").collect()
        assert len(found) == len({tuple(r) for r in found}) > 0
        assert written() - before < 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
