"""Phrases in texts: the automaton against plain search, large taxonomies, scopes, offsets and odd cases."""

import random

from docsift.operators import intent, metadata, phrases

SCHEMA = "phrase string, value string, ord int"


def plain(words, keys):
    return sorted((no, at) for no, k in enumerate(keys) for at in range(len(words)) if k and tuple(words[at - len(k) + 1 : at + 1]) == k and at - len(k) + 1 >= 0)


def test_automaton_equals_plain_search():
    r = random.Random(4)
    for _ in range(200):
        keys = [tuple(r.choice("abc") for _ in range(r.randrange(0, 5))) for _ in range(12)]
        words = [r.choice("abcd") for _ in range(40)]
        assert sorted(phrases.Automaton(keys).find(words)) == plain(words, keys)


def test_a_large_taxonomy_in_one_pass_gives_the_rows_of_plain_search(spark):
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)]
    wanted = [tuple(r.choice(vocabulary) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    others = [("x%d" % i, "y%d" % (i % 977)) for i in range(100_000)]
    texts = [(i, " ".join(r.choice(vocabulary + ["x7 y7"]) for _ in range(30))) for i in range(40)]
    keys = [*wanted, *others]
    table = spark.createDataFrame([(" ".join(k), str(i), i) for i, k in enumerate(keys)], SCHEMA)
    out = phrases.annotate(spark.createDataFrame(texts, "id long, text string"), table, ["text"])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    by = {}
    for i, k in enumerate(keys):
        by.setdefault(k, []).append(i)
    for row in out.collect():
        words = texts[row.id][1].split()
        want = {}
        for n in (1, 2, 3):
            for at in range(len(words) - n + 1):
                for no in by.get(tuple(words[at : at + n]), []):
                    want[no] = want.get(no, 0) + 1
        assert {m.ord: m.times for m in row.mentions} == want
        assert all(texts[row.id][1][m.begin : m.end] == m.phrase for m in row.mentions)


def test_scopes_by_a_sweep():
    finder = phrases.Finder(["steel", "water", "water pipeline", "brass"], ("s", "ing"), True)
    say = lambda t: {(no, scope): where for (no, scope), where in finder.mentions(t, intent.scopes).items()}
    text = "steel valve on the steel water pipeline, not of brass; brass"
    got = say(text)
    assert got[0, ""] == [0, 5, 1] and got[0, "context"] == [19, 24, 1]
    assert got[1, "context"][2] == 1 and got[2, ""][2] == 1  # the pipeline itself is not what it stands on
    assert got[3, "negation"] == [text.index("brass"), text.index("brass") + 5, 1] and got[3, ""][2] == 1
    assert (0, "negation/context") in say("not for steel pipelines or a main, on steel") or (0, "negation") in say("not for steel lines")
    assert say("water. pipeline") == {(1, ""): [0, 5, 1]}  # a stop parts words
    assert say("steels and steeling, steely") == {(0, ""): [0, 6, 2]}
    assert say("") == {}


def test_reverse_flow_excludes_nothing_from_a_valve(spark):
    vocabulary = spark.createDataFrame([("product", "valve", "valve", 0), ("medium", "water", "water", 0), ("function", "structural_fastening", "hold", 0), ("medium", "potable", "potable", 1)], "field string, value string, phrase string, ord int")
    texts = [(1, "valve, no water may come back"), (2, "pipe, no water may come back"), (3, "hold"), (4, "hold the joint"), (5, "no potable"), (6, "no potable; non potable"), (7, None), (8, "water"), (9, "water, no water")]
    got = {r.query_id: r for r in intent.intents(spark.createDataFrame(texts, "query_id long, text string"), vocabulary).collect()}
    assert got[1].q_medium == ["water"] and got[1].q_function == ["prevent_reverse_flow"] and got[1].q_excluded_medium == []
    assert got[2].q_medium == [] and got[2].q_excluded_medium == []
    assert got[3].q_function == [] and got[4].q_function == ["structural_fastening"]
    assert got[5].q_excluded_medium == ["potable water"] and got[6].q_excluded_medium == ["potable"]
    assert got[7].q_medium == [] and got[8].q_medium == ["water"] and got[9].q_medium == []
    named = spark.createDataFrame([(1, "no water may come back", "valve")], "query_id long, text string, product string")
    assert intent.intents(named, vocabulary).first().q_medium == ["water"]


def test_odd_cases(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "Pump PUMP pump " * 50_000, 3), (3, "pump", 3)], "id long, text string, times int")
    table = spark.createDataFrame([("pump", "a", 1), ("Pump", "b", 2), ("", "c", 3), (None, "d", 4), ("--", "e", 5)], SCHEMA)
    got = sorted((r.id, r.times, sorted((m.value, m.times) for m in r.mentions)) for r in phrases.annotate(rows, table, ["text"]).collect())
    assert got == [(1, 3, []), (2, 3, []), (3, 3, [("a", 1), ("b", 1)]), (3, 3, [("a", 150_000), ("b", 150_000)])]
    assert phrases.annotate(rows.limit(0), table, ["text"]).count() == 0
    assert [r.mentions for r in phrases.annotate(rows.limit(1), table.limit(0), ["text"]).collect()] == [[]]


def test_metadata_needs_no_shuffle(spark):
    aliases = spark.createDataFrame([("pipe", "pipe", 1)], "product string, phrase string, ord int")
    families = spark.createDataFrame([("pipe", "pipes")], "product string, family string")
    patterns = spark.createDataFrame([("material", "PVC", "pvc", 1, False)], "field string, value string, phrase string, ord int, headings_only boolean")
    records = spark.createDataFrame([(1, "pvc pipe", None, None, None), (2, None, "of pipe", None, "pvc")], "id long, title string, scope string, summary string, full_text string")
    out = metadata.derive(records, aliases, families, patterns, [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r.id, r.product, r.material, r.evidence) for r in out.collect()) == [(1, "pipe", "PVC", ["title"]), (2, "pipe", "PVC", ["scope"])]
