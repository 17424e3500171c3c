"""Text extraction on conversations (turns are items of a requirement), documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import details as D
from docsift.operators import facts as X

from .dialect import sql_query
from .registry import query

sql_query("excerpts", "SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE concat(rtrim(substring(text, 1, 237)), '...') END AS excerpt FROM documents", "X4")
sql_query("scrub_codes", "SELECT doc_id, @md5{@gsub{text|'[0-9][0-9.]*[0-9]'|'#'}} AS scrubbed_md5, @size{@all{text|'[0-9][0-9.]*[0-9]'|0}} AS n_codes FROM documents", "X9")
sql_query("grade_facts", "SELECT doc_id, @at{@all{lower(text)|'(the|der|les) ([a-z]+)'|2}|1} AS first_grade, @size{@all{lower(text)|'(the|der|les) ([a-z]+)'|2}} AS n_grades FROM documents", "X13")
sql_query(
    "keyword_sentence_facts",
    """WITH kw AS (SELECT * FROM (VALUES ('limit', 'this', 1), ('limit', 'that', 2), ('scope', 'from', 3), ('test', 'with', 4)) AS t(kind, word, ord)),
 s AS (SELECT doc_id, sentence FROM (SELECT doc_id, @unnest{@distinct{@split{lower(text)|'[.;]'}}} AS sentence FROM documents) AS u WHERE length(sentence) BETWEEN 24 AND 500)
 SELECT doc_id, @md5{sentence} AS sentence_md5, @first{kind|ord} AS kind FROM (SELECT doc_id, sentence, kind, ord FROM s JOIN kw ON @within{sentence|word} > 0) AS f GROUP BY doc_id, sentence""",
    "X14, X15: the first keyword in table order names a sentence",
)
sql_query("code_parts", "SELECT o_orderkey, year(o_orderdate) AS revision_year, @at{@split{o_orderpriority|'-'}|1} AS part_no, @at{@split{o_orderpriority|'-'}|2} AS section FROM orders", "X18")
sql_query("negation_phrases", "SELECT doc_id, @size{@all{lower(text)|'(not|no|except|excluding|without|nicht|pas|sin) ([a-z0-9/ -]+)'|2}} AS n, @at{@all{lower(text)|'(not|no|except|excluding|without|nicht|pas|sin) ([a-z0-9/ -]+)'|2}|1} AS first_phrase FROM documents", "X19")
sql_query("grade_temperature", "SELECT p_partkey, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS grade, CASE WHEN p_name LIKE 'hot%' THEN CAST(p_size AS DOUBLE) * 10 WHEN p_name LIKE 'cold%' THEN -CAST(p_size AS DOUBLE) END AS temperature_c FROM part", "X20")
sql_query("intent_values", "SELECT p_partkey, CASE WHEN p_name LIKE '%bolt' OR p_name LIKE '%rod' THEN 'structural' WHEN p_name LIKE '%gear' THEN 'power' ELSE 'general' END AS application, CASE WHEN p_type LIKE 'P%' THEN 'water' WHEN p_type LIKE 'S%' THEN 'sewage' END AS medium FROM part", "Z4, Z6")
sql_query("enriched_query", "SELECT p_partkey, concat_ws('; ', p_name, p_type, CASE WHEN p_size > 25 THEN concat('size ', @str{p_size}) END, CASE WHEN p_name LIKE 'hot%' THEN 'temperature 100 C' END) AS enriched FROM part", "X22")
sql_query("query_templates", "SELECT p_partkey, @size{q} AS n, @join{@slice{q|1|12}|' / '} AS queries FROM (SELECT p_partkey, @compact{concat('need ', p_name), concat(p_name, ' for ', p_type), CASE WHEN p_size > 20 THEN concat(p_name, ' of size ', @str{p_size}) END, CASE WHEN p_name LIKE 'hot%' THEN concat(p_name, ' for high temperature') END} AS q FROM part) AS t", "X24, Z20")
sql_query("flag_state", "SELECT doc_id, nullif(regexp_extract(flags, 'LANG_([A-Z]+)', 1), '') AS lang_state, nullif(regexp_extract(flags, 'SIZE_([A-Z]+)', 1), '') AS size_state FROM (SELECT doc_id, concat('LANG_', upper(lang), ' SIZE_', CASE WHEN n_chars > 2000 THEN 'LONG' ELSE 'SHORT' END) AS flags FROM documents) AS f", "X27")
sql_query("list_merge", "SELECT p_partkey, @join{@sort{@filter{@distinct{@arr{p_type, @at{@split{p_name|' '}|1}, p_brand, @at{@split{p_name|' '}|1}}}|x <> 'red'}}|','} AS merged FROM part", "U5")
sql_query("fact_dedupe", "SELECT conv_id, role, turn, @md5{text} AS text_md5 FROM (SELECT *, @rank{PARTITION BY conv_id, lower(role), lower(text) ORDER BY turn} AS r FROM conversations) AS d WHERE r = 1", "W16")
sql_query("query_ids", "SELECT p_partkey, concat('fcq_', @gsub{lower(p_name)|'[^a-z0-9]+'|'_'}, '_', lpad(@str{n}, 4, '0')) AS query_id FROM (SELECT p_partkey, p_name, @rank{PARTITION BY p_name ORDER BY p_partkey} AS n FROM part) AS q", "W17")


@query("key_description")
def key_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two sentences, 240 characters; the other engine has no look-behind."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.excerpt(F.array_join(F.slice(T.sentences(F.col("text")), 1, 2), " "), 240).alias("description"))


@query("summary_heading")
def summary_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", X.summary_heading(F.col("text"), marker="(?:the|der|les|las)\\b").alias("heading"))


@query("scope_text")
def scope_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", X.scope_text(F.concat(F.lit("1. Scope - "), "text")).alias("scope"))


@query("fact_extract")
def fact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of whole documents with their places and evidence."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.explode(D.extract_details(F.col("text"))).alias("f")).select("doc_id", "f.*")


@query("fuzzy_alias")
def fuzzy_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values only are compared with the aliases."""
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.split("p_name", " ")[1].alias("noun")).distinct()
    return d.withColumn("alias", X.fuzzy_alias(F.translate("noun", "g", ""), ["anvil", "bolt", "gear", "plate", "ring"]))
