"""Corpus audit, canonical records, the store and its verification, on the driver tables.

documents are the parsed records: source is the title, the first line the scope, text the full text; the lower-case text of
single spaces is the key under which records are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import corpus as C

from .dialect import sql_query
from .registry import query

sql_query("scan_filter_sorted", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND text IS NOT NULL ORDER BY doc_id", "R1")
sql_query("lookup_by_key", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42", "R3")
sql_query("integrity_counts", "SELECT count(doc_id) AS n, count(DISTINCT doc_id) AS n_ids, count(DISTINCT text) AS n_texts, @if{text IS NULL OR text = ''} AS n_empty FROM documents", "R4")
sql_query("duplicate_keys", "SELECT count(*) AS n_keys, @sum{n} AS n_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) AS d", "R4, U6")
sql_query("retrieval_fulltext_ratio", "SELECT count(*) AS n FROM documents d JOIN benchmark b ON d.doc_id = b.item_id WHERE length(d.text) > 800 AND length(b.text) > 0.1e0 * length(d.text)", "R5")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        (F.col("doc_id") + 1).alias("source_index"),
        F.when(F.col("doc_id") % 50 != 7, F.concat(F.lit("IS "), F.col("doc_id").cast("string"))).alias("code"),
        T.leakage_key(F.col("text")).alias("key"),
        F.col("source").alias("title"),
        F.split("text", "\n")[0].alias("scope"),
        F.col("text").alias("full_text"),
        (F.col("doc_id") % 90).alias("page_start"),
        (F.col("doc_id") % 91).alias("page_end"),
    )


PATTERN = "(?i)(th|ion|ment|ung)[a-z]*[.]"
RECORDS_SQL = """records AS (SELECT doc_id + 1 AS source_index, CASE WHEN doc_id % 50 <> 7 THEN 'IS ' || doc_id END AS code,
 trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, source AS title, string_split(text, chr(10))[1] AS scope, text AS full_text, doc_id % 90 AS page_start, doc_id % 91 AS page_end FROM documents)"""
ISSUES_SQL = f"""issues AS (SELECT source_index, unnest(list_filter([CASE WHEN code IS NULL THEN 'missing_code' END, CASE WHEN nullif(trim(key), '') IS NULL THEN 'missing_key' END,
 CASE WHEN nullif(trim(title), '') IS NULL THEN 'missing_title' END, CASE WHEN nullif(trim(scope), '') IS NULL THEN 'missing_scope' END, CASE WHEN nullif(trim(full_text), '') IS NULL THEN 'missing_full_text' END,
 CASE WHEN length(trim(title)) + length(trim(scope)) + length(trim(full_text)) < 80 THEN 'short_record' END, CASE WHEN length(trim(title)) + length(trim(scope)) + length(trim(full_text)) > 25000 THEN 'long_record' END,
 CASE WHEN len(regexp_extract_all(full_text, '{PATTERN}')) >= 5 OR contains(lower(full_text), 'merged') THEN 'possible_merge' END, CASE WHEN page_end < page_start THEN 'invalid_page_range' END], lambda x: x IS NOT NULL)) AS issue_type FROM records)"""


@query("corpus_audit_issues", f"WITH {RECORDS_SQL}, {ISSUES_SQL} SELECT * FROM issues")
def corpus_audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, Z13."""
    return C.audit_issues(_records(spark, sf_dir), PATTERN)


@query("corpus_audit_summary", f"WITH {RECORDS_SQL}, {ISSUES_SQL} SELECT issue_type, count(*) AS n, count(*) / (SELECT count(*) FROM records)::DOUBLE AS share FROM issues GROUP BY ALL")
def corpus_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, G6."""
    records = _records(spark, sf_dir)
    total = records.agg(F.count("*").alias("total"))
    return C.audit_issues(records, PATTERN).groupBy("issue_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("issue_type", "n", (F.col("n") / F.col("total")).alias("share"))


@query("canonical_dedupe", f"""WITH {RECORDS_SQL}, s AS (SELECT *, length(full_text) AS score FROM records)
SELECT md5(key) AS key_md5, source_index, score AS quality_score, n AS source_record_count, conflicting FROM (
 SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, source_index) AS r, count(*) OVER (PARTITION BY key) AS n, min(lower(title)) OVER (PARTITION BY key) <> max(lower(title)) OVER (PARTITION BY key) AS conflicting FROM s) WHERE r = 1""")
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest record of each key, then the first."""
    out = C.canonical(_records(spark, sf_dir), "key", F.char_length("full_text").cast("long"), "source_index")
    return out.select(F.md5("key").alias("key_md5"), "source_index", "quality_score", "source_record_count", "conflicting")


sql_query("conflicting_duplicates", "SELECT @md5{text} AS text_md5, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY text HAVING count(DISTINCT source) > 1", "G5")
sql_query("duplicate_title_keys", "SELECT source, @md5{text} AS text_md5, count(*) AS n FROM documents GROUP BY source, text HAVING count(*) > 1", "F3")
sql_query(
    "merged_artifact",
    """SELECT doc_id, n_marks, CASE WHEN has_code AND has_title AND has_summary AND has_scope THEN 'SAFE' WHEN has_code AND (has_summary OR has_scope) THEN 'REVIEW_REQUIRED' ELSE 'UNSAFE' END AS classification FROM (
 SELECT doc_id, @size{@all{lower(text)|'th[a-z]*[.]'|0}} AS n_marks, doc_id % 50 <> 7 AS has_code, source IS NOT NULL AS has_title, @within{text|chr(10)} > 0 AS has_summary, length(text) > 200 AS has_scope FROM documents) AS m
 WHERE n_marks >= 5""",
    "F4, F5",
)
sql_query(
    "quality_flags",
    """SELECT doc_id, @join{@compact{CASE WHEN length(text) < 80 THEN 'short_text' END, CASE WHEN length(text) > 25000 THEN 'long_text' END, CASE WHEN NOT @within{text|chr(10)} > 0 THEN 'single_line' END,
 CASE WHEN upper(text) = text THEN 'upper_case' END, CASE WHEN @within{text|'$$$'} > 0 THEN 'symbols' END, CASE WHEN lang <> 'en' THEN 'not_english' END, CASE WHEN n_chars <> length(text) THEN 'length_mismatch' END}|';'} AS flags FROM documents""",
    "F7",
)
sql_query(
    "dataset_rule_checks",
    """SELECT @join{@compact{CASE WHEN n <> n_ids THEN 'duplicate_ids' END, CASE WHEN n <> n_keys THEN 'duplicate_keys' END, CASE WHEN n_empty > 0 THEN 'empty_text' END, CASE WHEN n_bad > 0 THEN 'bad_prefix' END, CASE WHEN families <> 20 THEN 'family_counts_mismatch' END}|';'} AS errors, n, n <> n_ids OR n <> n_keys OR n_empty > 0 OR n_bad > 0 OR families <> 20 AS skip_all FROM (
 SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(DISTINCT text) AS n_keys, @if{text = ''} AS n_empty, @if{source NOT LIKE 'src%'} AS n_bad, count(DISTINCT source) AS families FROM documents) AS c""",
    "F6: any error keeps the whole set out",
)

OLD = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 7 <> 0"
NEW = "SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0"
MERGED_SQL = f"""m AS (SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.name IS NOT DISTINCT FROM n.name AND o.bal IS NOT DISTINCT FROM n.bal AND o.seg IS NOT DISTINCT FROM n.seg THEN 'unchanged' ELSE 'updated' END AS change,
 CASE WHEN n.k IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.k IS NULL THEN o.bal ELSE n.bal END AS bal, CASE WHEN n.k IS NULL THEN o.seg ELSE n.seg END AS seg FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k)"""


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    row = lambda name, bal: [k.alias("k"), name.alias("name"), bal.alias("bal"), F.col("c_mktsegment").alias("seg")]
    old = c.where(k % 7 != 0).select(*row(F.col("c_name"), F.col("c_acctbal")))
    new = c.where(k % 3 != 0).select(*row(F.when(k % 11 != 0, F.col("c_name")), F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))))
    return C.upsert(old, new, "k", ["name", "bal", "seg"])


@query("upsert_classify", f"WITH {MERGED_SQL} SELECT change, count(*) AS n FROM m GROUP BY change")
def upsert_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a load inserts, updates and leaves."""
    return _upserted(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query("upsert_overwrite", f"WITH {MERGED_SQL} SELECT * FROM m")
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULLs overwrite too."""
    return _upserted(spark, sf_dir)


sql_query("index_verification", "SELECT n_source, n_index, n_text, CASE WHEN n_source = n_index AND n_index = n_text THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT (SELECT count(*) FROM documents) AS n_source, (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_index, (SELECT @if{text IS NOT NULL} FROM documents) AS n_text) AS v", "S11, Z38")
sql_query(
    "runtime_verification",
    """SELECT *, @join{@compact{CASE WHEN n_docs <> n_ids THEN 'ids_not_unique' END, CASE WHEN n_labels > n_docs THEN 'more_labels_than_documents' END, CASE WHEN orphans > 0 THEN 'labels_without_document' END, CASE WHEN n_vectors <> n_docs THEN 'vector_count_mismatch' END}|';'} AS errors FROM (
 SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT doc_id) FROM documents) AS n_ids, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL) AS orphans) AS v""",
    "S12",
)
sql_query("pair_contract_violations", "SELECT doc_id, CASE WHEN toxic NOT IN (0, 1) THEN 'label' WHEN toxic = 1 AND quality = 0 THEN 'type_mismatch' ELSE 'blank' END AS rule FROM labels WHERE toxic NOT IN (0, 1) OR (toxic = 1 AND quality = 0)", "S7")
sql_query("missing_extra_keys", "SELECT d.doc_id AS k, 'missing' AS side FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL UNION ALL SELECT l.doc_id, 'extra' FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL", "J4, U3")
sql_query("suite_compatibility", "SELECT b.item_id, d.doc_id IS NOT NULL AS in_corpus, e.vec_id IS NOT NULL AS in_index FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 30 LEFT JOIN embeddings e ON e.vec_id = b.item_id * 30", "J4")
sql_query("validate_with_replacement", "SELECT o.o_orderkey, CASE WHEN o.o_orderstatus = 'F' THEN 'SUPERSEDED' WHEN o.o_orderstatus = 'P' THEN 'WITHDRAWN' ELSE 'ACTIVE' END AS status, r.replacement FROM orders o LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS replacement FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) r ON o.o_custkey = r.o_custkey AND o.o_orderstatus <> 'O'", "D26")
sql_query("vector_payload", "SELECT e.vec_id, coalesce(d.lang, 'unknown') AS lang, coalesce(d.source, 'none') AS source, e.label, @size{e.embedding} AS dim FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id", "Z10")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("dst"), F.concat(F.lit(" return "), F.lower("l_returnflag"), F.lit(" ")).alias("relation"), F.col("l_orderkey").alias("evidence"), F.struct("l_orderkey", "l_linenumber").alias("at"))


EDGES_SQL = """e AS (SELECT 'P' || l_partkey AS src, 'RETURN_' || upper(l_returnflag) AS relation, 'S' || l_suppkey AS dst, arg_max(l_orderkey, l_orderkey * 100 + l_linenumber) AS evidence FROM lineitem GROUP BY ALL)"""


@query("graph_merge", f"WITH {EDGES_SQL} SELECT * FROM e")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2."""
    return C.graph_merge(_edges(spark, sf_dir), "at")


@query("allied_neighbors", f"""WITH {EDGES_SQL}, n AS (SELECT 'P' || p_partkey AS id FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier), b AS (SELECT src, dst, relation FROM e UNION SELECT dst, src, relation FROM e)
SELECT id, relation, dst AS neighbor FROM n LEFT JOIN b ON src = id""")
def allied_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, GR1."""
    p, s = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nodes = p.select(F.concat(F.lit("P"), "p_partkey").alias("id")).union(s.select(F.concat(F.lit("S"), "s_suppkey")))
    return C.allied(nodes, C.graph_merge(_edges(spark, sf_dir), "at"))
