"""Each stage on what the one before kept, against brute force where there is one."""

import pytest
from test_packing_dedup import brute_components, brute_spans

import corpus_pipeline
from docsift.llm import decontaminate, substring, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        kept.append((name, docs.columns, {r.doc_id: r for r in docs.collect()}, rows))
        docs = spark.createDataFrame(rows) if name != "packing" else None
    return {name: (columns, before, rows) for name, columns, before, rows in kept}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for name, (columns, before, rows) in stages.items():
        if name != "packing":
            assert rows[0].__fields__ == columns and {r.doc_id for r in rows} <= set(before)
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert all(r == before[r.doc_id] for r in rows)


def test_toxicity_drops_what_it_scores_high(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r.doc_id for r in stages["toxicity"][2]} == {r.doc_id for r in scored if r.toxicity_score < 0.3}


def test_near_dedup(stages):
    _, before, rows = stages["near_dedup"]
    want = brute_components([(i, r.text) for i, r in before.items()], 5)
    assert {r.doc_id for r in rows} == {i for i, (_, c) in want.items() if i == c} and len(rows) < len(before)


def test_substring(stages):
    _, before, rows = stages["substring_dedup"]
    gone = brute_spans([(i, r.text) for i, r in before.items()], substring.LEAST)

    def left(i):
        text, at, out = before[i].text, 0, ""
        for s, e in gone.get(i, []):
            out, at = out + text[at:s], e
        return out + text[at:]

    want = {i: left(i) for i in before if i not in gone or left(i).strip()}
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == (len(r.text) if r.doc_id in gone else before[r.doc_id].n_chars) for r in rows)


def test_decontamination(spark, stages):
    _, before, rows = stages["decontamination"]
    items = [(r.item_id, decontaminate.normalise(r.text)[0].strip()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher([x for x in items if len(x[1]) >= decontaminate.SHORTEST], decontaminate.RATE)
    exact = {i for i, r in before.items() if any(x in decontaminate.normalise(r.text)[0] for _, x in items if len(x) >= decontaminate.SHORTEST)}
    kept = {r.doc_id for r in rows}
    assert kept == {i for i, r in before.items() if not matcher.search(r.text)} and not kept & exact


def test_packing_holds_every_document(stages):
    _, before, rows = stages["packing"]
    assert {r.doc_id for r in rows} == set(before)
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in rows)


def test_odd_documents_and_columns(spark, tmp_path):
    """Nulls in any column, names that stages use themselves, repeated ids, and no documents at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _toxicity double, _spans int, _gone int, _removed int, kept int"
    long = " ".join(f"w{i * i % 977}" for i in range(400))
    rows = [(None, "x y", None, None, None, 1.0, 1, 1, 1, 1), (1, None, None, None, None, 2.0, 2, 2, 2, 2), (2, "", "en", "s", 0, None, None, None, None, None)]
    rows += [(3, long, "en", "s", len(long), 3.0, 3, 3, 3, 3)] * 2 + [(4, long, "en", "s", len(long), 4.0, 4, 4, 4, 4), (5, "end " + long[:700], "en", "s", 704, 5.0, 5, 5, 5, 5)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        got = sorted(docs.collect(), key=str)
        assert len(got) == (5 if given else 0)
        assert all((r._toxicity, r.kept) == {None: (1.0, 1), 1: (2.0, 2), 2: (None, None), 3: (3.0, 3), 5: (5.0, 5)}[r.doc_id] for r in got)
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == len(got)
