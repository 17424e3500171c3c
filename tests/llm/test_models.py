"""Language, quality, toxicity: held-out accuracy, and their odd cases."""

import duckdb
import numpy as np
import pytest

from docsift.llm import language, licences, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "the of and"), (1, None), (2, ""), (3, "1234 .. !!"), (4, "x" * 300_000), (5, "the of and"), (5, "the of and")]


def odd(spark, extra="score double, lang_pred string, toxicity_score double, x int, y int, held_out int"):
    n = len(extra.split(","))
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in ODD], f"doc_id long, text string, {extra}")


def labelled(spark, name, column):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all()
    return got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")


def area(p, n):
    return np.mean([(n < x).mean() + (n == x).mean() / 2 for x in p])


def test_language_held_out(spark):
    got = queries.QUERIES["op3_language"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    want = duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").df().doc_id
    import zlib

    assert {i for i in want if zlib.crc32(str(i).encode()) % 4 == 2} == set(held.doc_id)


def test_language_mixture():
    texts = {"a": "aba bab abab baba " * 50, "b": "cdc dcd cdcd dcdc " * 50}
    p = np.zeros((language.BUCKETS, 2))
    for i, t in enumerate(texts.values()):
        p[:, i] = np.bincount(language.ngrams([" ", t])[1], minlength=language.BUCKETS)
    model = language.Model(list(texts), ((p + 0.5) / (p.sum(0) + 0.5 * language.BUCKETS)).astype("f4"))
    share = model.proportions(["aba bab " * 30, "aba " * 30 + "cdc " * 10, None, "12 !"])
    assert share[0].tolist() == [1, 0] and abs(share[1, 0] - 0.75) < 0.03 and share[2:].sum() == 0
    lang, score = model.told(["aba bab", None, "", "42", "a"])
    assert lang[0] == "a" and lang[1:4] == ["und"] * 3 and score[1:4] == [0, 0, 0] and lang[4] in ("a", "b")


def test_language_odd_rows(spark):
    docs = odd(spark)
    model = language.fit(spark.createDataFrame([("the of", "en"), (None, "en"), ("der", None)], "text string, lang string"))
    assert model.langs == ["en"]
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, model, proportions=True).collect()}
    assert got == {(None, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en")}
    empty = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    held = (got := labelled(spark, "op9_quality", "quality"))[got.held_out]
    assert ((held.quality == 1) == (held.predicted == 1)).mean() > 0.95
    assert area(held[held.quality == 1].score.values, held[held.quality == 0].score.values) > 0.95


def test_quality_parts(spark):
    assert quality.isotonic(np.array([3.0, 1.0, 2.0, 5.0]), np.array([1.0, 1.0, 2.0, 1.0])).tolist() == [2, 2, 2, 5]
    assert all(np.isfinite(quality.statistics(t)).all() for _, t in ODD)
    assert quality.measured(odd(spark)).count() == len(ODD)
    rows = quality.measured(odd(spark))
    from pyspark.sql import functions as F

    assert quality.fit(rows.select("x", F.lit(1).alias("y"))).constant == 1
    assert quality.fit(rows.limit(0).select("x", F.lit(1).alias("y"))).constant == 0.5


def test_normal_equations_are_those_of_all_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, quality.WIDTH)).astype("f4")
    rows = spark.createDataFrame([(a.tolist(), int(a[0] > 0)) for a in x], "x array<float>, y int").repartition(7)
    model = quality.fit(rows, features=64, ridge=1e-3)
    z = model.features(x.astype("f8"))
    y = (x[:, 0] > 0).astype(float)
    keep = np.full(65, 1e-3 * 300 / 64)
    keep[-1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(keep), z.T @ y), atol=1e-6)


def test_toxicity_held_out(spark):
    held = (got := labelled(spark, "op5_toxicity", "toxic"))[got.held_out]
    assert ((held.toxic == 1) == (held.predicted == 1)).mean() > 0.9


def test_toxicity_learns_from_all_but_copies(spark):
    texts = [(i, f"the same words but number{i} and other{i % 7}") for i in range(200)]
    texts += [(1000 + i, "One copy of this") for i in range(5)] + [(2000, "of this one COPY")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marked = spark.createDataFrame([(i, int(i % 3 == 0 or i == 1004)) for i, _ in texts], "doc_id long, y int")
    got = {r.doc_id: r.y for r in toxicity.learned(docs, marked, 20_000).collect()}
    ones = [i for i in range(1000, 1005) if i % 3 == 0 or i == 1004]
    assert got == {i: int(i % 3 == 0) for i in range(200)} | {min(ones): 1, 1000: 0}


@pytest.fixture(scope="module")
def restorer():
    counts = np.bincount(toxicity.trigrams("the thing is another that this idiot stupid moron loser other string theory " * 50), minlength=toxicity.N**3).astype("f8")
    return toxicity.Restorer(counts, {"idiot": 3.0, "stupid": 3.0, "loser": 3.0})


@pytest.mark.parametrize("hidden, word", [("1d10t", "idiot"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("loooser", "loser"), ("l0s3r", "loser"), ("m0ron", "moron"), ("1diiiot", "idiot")])
def test_restores(restorer, hidden, word):
    assert toxicity.suspicious(f"on {hidden}, there.") and word in restorer.text(f"on {hidden}, there.")


@pytest.mark.parametrize(
    "hidden, word",
    [
        (" ".join("this stupid idiot is another moron loser".replace(" ", "")), "stupid"),
        (" ".join("this stupid idiot is another moron loser".replace(" ", "")), "loser"),
        ("a s t u p i d", "stupid"),
        ("s........t........u........p........i........d", "stupid"),
        ("i.d.i........................................o.t", "idiot"),
        ("st" + "u" * 60 + "pid", "stupid"),
        ("/".join(["path"] * 60) + "/1d10t/end", "idiot"),
        ("the-string-" * 30 + "$tup1d", "stupid"),
    ],
)
def test_restores_tokens_of_any_length(restorer, hidden, word):
    assert word in toxicity.counted(f"on {hidden} there.", restorer)[0]


def test_long_tokens_are_searched_as_short_ones():
    r = np.random.default_rng(5)
    for _ in range(5000):
        t = "".join(r.choice(list("abc1$.-*#/"), p=[0.2, 0.2, 0.1, 0.1, 0.1, 0.08, 0.06, 0.06, 0.06, 0.04], size=60))
        want = [m[0] for m in toxicity.INSIDE.finditer(t)]
        assert toxicity.inside(t + "/" * 200) == want, t
    assert toxicity.inside("ab..cd--" * 20_000 + "1") == []


@pytest.mark.parametrize("clean", ["The quick, brown fox - it's 42.", "a!! b&&& of%%% them***", "192.168.0.1", "", "3.14 + 2"])
def test_leaves_clean_text_alone(restorer, clean):
    assert restorer.text(clean) == clean


def test_toxicity_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    for use in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.score(docs, toxicity.fit(docs, use)).collect()
        assert len(got) == len(ODD) and all(0 <= r.toxicity_score <= 1 for r in got)
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_licences_equal_brute_force(spark):
    mit = dict(licences.TEMPLATES)["MIT"].split()
    wrapped = "/* " + "\n * ".join(" ".join(mit[i : i + 6]) for i in range(0, len(mit), 6)) + "\n */"
    texts = [(i, f"Some line here.\n{t}\nand more") for i, (_, t) in enumerate(licences.TEMPLATES)]
    texts += [(50, None), (51, ""), (52, "MIT"), (53, "Released under the mit  licence! License"), (54, "x " * 50_000), (55, "Released under the MIT License.\nReleased under the MIT License."), (None, "Released under the MIT License.")]
    texts += [(56, wrapped), (57, "It is good. It was released under the MIT License, and we like it."), (58, "word " * 30_000 + wrapped), (59, " ".join(mit[:12] + ["and", "so", "on"] + mit[12:])), (60, "the license of the software"), (61, " ".join(mit[::2]))]
    docs = spark.createDataFrame([(i, t, 1, 1.0) for i, t in texts], "doc_id long, text string, word int, dice double")
    grams = lambda w: list(zip(w, w[1:], strict=False))
    want = {}
    for i, text in texts:
        g = grams(licences._words(text or ""))
        for name, template in licences.TEMPLATES:
            whole = grams(licences._words(template))
            for at in range(len(g)):
                a, b = set(g[at : at + len(whole)]), set(whole)
                if g[at] in b and (d := 2 * len(a & b) / (len(a) + len(b))) >= licences.THRESHOLD:
                    want[i, name] = max(want.get((i, name), (0, 0)), (round(d, 6), -at - 1))
    got = {(r.doc_id, r.license): (r.dice, -r.word) for r in licences.scan(docs).collect()}
    assert got == want and len(got) >= len(licences.TEMPLATES) and {56, 57, 58, 59} <= {i for i, _ in got}
    assert licences.scan(docs.limit(0)).count() == 0


def cheapest(restorer, token):
    """The letters of the cheapest decodings of a token (several if they cost the same), every one tried by itself."""
    all_ = {}

    def go(i, a, b, last, cost, out):
        if i == len(token):
            cost += float(restorer.cost[a, b, 0]) if b else 0.0
            all_[out] = min(cost, all_.get(out, cost))
            return
        c = token[i]
        index = lambda x: int(toxicity.INDEX[ord(x)])
        ways = [(c, 0.05)] if c.isalpha() else [(x, 0.7) for x in toxicity.LEET.get(c, "")]
        ways += [(x, 2.5) for x in "aeiou"] if c in "*#" else []
        skip = 0.4 if c in toxicity.BETWEEN else 3.0 if not c.isalnum() else None
        for x, extra in ways:
            go(i + 1, b, index(x), x, cost + extra + float(restorer.cost[a, b, index(x)]), out + x)
        drop = 0.5 if c.isalpha() and c == last else 1.0 if last and last in toxicity.LEET.get(c, "") else skip
        if drop is not None:
            go(i + 1, a, b, last, cost + drop, out)
        if b and c in toxicity.ENDS:
            go(i + 1, 0, 0, "", cost + skip + float(restorer.cost[a, b, 0]), out + " ")

    go(0, 0, 0, "", 0.0, "")
    return {out for out, cost in all_.items() if cost <= min(all_.values()) + 1e-4}


def test_viterbi_finds_the_cheapest_of_all_decodings():
    import random

    counts = np.zeros(toxicity.N**3)
    for w in ("idiot", "stupid", "moron", "the", "house", "still"):
        np.add.at(counts, toxicity.trigrams(w), 40)
    restorer, r = toxicity.Restorer(counts), random.Random(9)
    for _ in range(150):
        token = "".join(r.choice("iidot1!0$.-* suph") for _ in range(r.randrange(2, 8)))
        if any(c.isalpha() for c in token):
            assert restorer.restore(token) in {x.strip() or token for x in cheapest(restorer, token)}, token


def test_mixture_equals_plain_em():
    """Proportions of the penalised best set against a plain EM in double precision, set by set."""
    r = np.random.default_rng(1)
    langs = ["a", "b", "c", "d", "e", "f"]
    likelihood = r.dirichlet(np.full(language.BUCKETS, 0.02), len(langs)).T.astype("f4") + 1e-7
    model = language.Model(langs, likelihood)
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "zwölf boxkämpfer jagen viktor quer über den sylter deich", "x"]
    got = model.proportions(texts)
    for t, g in zip(texts, got, strict=True):
        _, bucket = language.ngrams([" ", t])
        p = likelihood[bucket].astype("f8")

        def em(start, p=p):
            share = start
            for _ in range(language.ROUNDS):
                w = share * p
                share = (w / w.sum(1, keepdims=True)).mean(0)
            return share

        first = em(np.full(len(langs), 1 / len(langs)))
        order, best = np.argsort(-first, kind="stable"), (-np.inf, None)
        for n in range(1, len(langs) + 1):
            allowed = np.isin(np.arange(len(langs)), order[:n])
            share = em((first + 1e-3) * allowed / ((first + 1e-3) * allowed).sum())
            value = np.log((share * p).sum(1)).sum() - 0.5 * (n - 1) * np.log(len(p))
            best = max(best, (value, n, share.tolist()), key=lambda x: x[0])
        assert np.abs(np.array(best[2]) - g).max() < 0.05 and int(g.argmax()) == int(np.argmax(best[2]))
