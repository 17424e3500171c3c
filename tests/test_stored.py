"""The stored index against the one in memory: batches, skipping, folders read, merging and odd cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docsift.operators import retrieval, stored

DOCS = "doc_id long, text string"


def prose(r, n):
    return " ".join("w%d" % min(int(r.expovariate(0.03)), 400) for _ in range(n))


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_batches_give_the_ranks_of_one_index(spark, tmp_path):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, prose(r, r.randrange(1, 80))) for i in range(400)] + [(500, None), (501, ""), (502, "w1 " * 500)], DOCS)
    queries = spark.createDataFrame([(i, prose(r, 8)) for i in range(20)] + [(50, "w399 w1 w1"), (51, "nowhere"), (52, None), (53, "")], "id int, q string")
    index = stored.StoredIndex(spark, str(tmp_path / "index"))
    assert rows(index.search(queries, "id", "q")) == []
    want = lambda d: rows(retrieval.Bm25Index(d, "doc_id", "text", queries, "id", "q").search(5))
    first, second = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    index.add(first, "doc_id", "text")
    assert rows(index.search(queries, "id", "q", 5)) == want(first)
    index.add(second, "doc_id", "text")
    assert rows(index.search(queries, "id", "q", 5)) == want(docs)
    merged = index.merge(str(tmp_path / "merged"))
    assert rows(merged.search(queries, "id", "q", 5)) == want(docs)
    count = lambda x: spark.read.parquet(f"{x.path}/postings").count()
    assert count(merged) < count(index)
    with pytest.raises(ValueError, match="in the index"):
        index.add(docs.where("doc_id = 7"), "doc_id", "text")
    assert rows(index.search(queries, "id", "q", 5)) == want(docs)


def test_a_search_reads_the_folders_of_its_terms_and_skips_blocks(spark, tmp_path):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.when(F.col("id") < 30, "rare rare"), F.concat(F.lit("x"), F.col("id") % 900), F.array_join(F.array_repeat(F.lit("y"), (F.col("id") % 40).cast("int")), " ")).alias("text"))
    index = stored.StoredIndex(spark, str(tmp_path / "index"))
    index.add(docs, "doc_id", "text")
    terms = spark.createDataFrame([("rare",), ("common",)], "tok string")
    found = index.blocks(terms)
    files = {re.search(r"part=(\d+)", f)[1] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1][:200]
    assert len(terms.select(stored._part(F.col("tok"))).distinct().collect()) <= 2 < len(files)
    queries = spark.createDataFrame([(1, "rare common")], "id int, q string")
    assert rows(index.search(queries, "id", "q", 10)) == rows(retrieval.Bm25Index(docs, "doc_id", "text", queries, "id", "q").search(10))


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    new, array = spark._jvm.java.util.ArrayList, spark.sparkContext._gateway.new_array
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(new(), False, False, array(spark._jvm.double, 0), new())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_shuffled_once(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(f"v{r.randrange(3000)}" for _ in range(200)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4).cache()
    postings, before = sum(len(set(t.split())) for t in texts), docs.count() and shuffled(spark)
    stored.StoredIndex(spark, str(tmp_path / "index")).add(docs, "doc_id", "text")
    assert postings <= shuffled(spark) - before < 1.2 * postings


def test_texts_of_one_document_go_together(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (1, None), (2, "a c c"), (3, "b"), (None, "a")], DOCS)
    index = stored.StoredIndex(spark, str(tmp_path / "index"))
    assert index.add(docs, "doc_id", "text") == 3
    found = {(r.tok, r.doc_id, r.tf, r.dl) for r in index._read("postings").select("tok", "tf", F.inline("docs")).collect()}
    assert found == {("a", 1, 2, 5), ("b", 1, 2, 5), ("c", 1, 1, 5), ("a", 2, 1, 3), ("c", 2, 2, 3), ("b", 3, 1, 1)}
