"""Operators of training data, corpus rows and evaluation on catalogue texts, with oracles from attributes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import details as D
from docsift.operators import evaluation as E
from docsift.operators import facts as A
from docsift.operators import intent as I
from docsift.operators import mapping as R
from docsift.operators import metadata as M
from docsift.operators import suites as S
from docsift.operators import training as L

from .catalogue import BASE, KIND_SQL, MATERIALS, PRODUCTS, _sql_map, candidates, parts, records
from .registry import query
from .suites import RANKS, SYSTEMS, _results

_NAME = _sql_map("string_split(p_name, ' ')[2]", PRODUCTS, 2)
N = f"n AS (SELECT a.*, {_NAME} AS name FROM a JOIN part ON p_partkey = id)"


@query("record_eligibility", f"""WITH {BASE} SELECT id, CASE WHEN size = 1 THEN 'NEEDS_REVIEW' WHEN size = 5 THEN 'UNSAFE_FLAGS' WHEN {KIND_SQL} <> 'other' THEN 'SEARCH_ONLY_KIND' WHEN size = 11 THEN 'NO_SUBJECT' WHEN size % 10 = 0 THEN 'NO_PRODUCT'
 WHEN size % 10 = 4 THEN 'LOW_CONFIDENCE' WHEN word = 'hot' THEN 'NO_GROUNDING' ELSE 'SAFE_FOR_TRAINING' END AS eligibility FROM a""")
def record_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight outcomes, the kind as derived from title and scope."""
    p = parts(spark, sf_dir).select("id", "size", "product")
    word = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("word"))
    r = records(spark, sf_dir).select("id", M.kind(F.col("title"), F.col("scope")).alias("kind")).join(p, "id").join(word, "id")
    size, none = F.col("size"), F.array().cast("array<string>")
    flags = F.when(size == 5, F.array(F.lit("merged_artifact"))).otherwise(none)
    subject, product = F.when(size != 11, F.lit("subject")), F.when(size % 10 != 0, F.col("product"))
    confidence = F.when(size % 10 == 4, "low").otherwise("high")
    return r.select("id", L.eligibility(size == 1, flags, F.col("kind"), subject, product, F.lit(None).cast("string"), confidence, F.col("word") != "hot").alias("eligibility"))


@query("error_classes", f"""WITH {BASE}, d AS (SELECT query_id, doc_id, CASE WHEN rank <> 5 THEN rank - 1 END AS pool_rank, CASE WHEN rank <= 4 THEN rank - 1 END AS place, x.product <> y.product AS other_function, x.product = y.product AND x.grade IS NOT DISTINCT FROM y.grade AS same_base,
 x.grade IS DISTINCT FROM y.grade AS other_subtype, x.material <> y.material AS other_material FROM c)
SELECT query_id, doc_id, CASE WHEN place = 1 THEN 'PASS' WHEN pool_rank IS NULL THEN 'RETRIEVAL_MISS' WHEN place IS NULL AND NOT other_function AND NOT same_base THEN 'RERANKER_ERROR' WHEN same_base THEN 'PART_OR_VARIANT_CONFUSION'
 WHEN other_function THEN 'FUNCTION_CONFUSION' WHEN other_subtype THEN 'SUBTYPE_CONFUSION' WHEN other_material THEN 'MATERIAL_APPLICATION_CONFUSION' ELSE 'RERANKER_ERROR' END AS error_class FROM d""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of what candidates were taken for, by what tells them from the wish."""
    p = parts(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("grade").alias("own_grade"), F.col("wants_material").alias("own_material"))
    c = candidates(spark, sf_dir).join(p, "doc_id")
    place, pool = F.when(F.col("rank") <= 4, F.col("rank") - 1), F.when(F.col("rank") != 5, F.col("rank") - 1)
    function, subtype = F.col("q_product") != F.col("product"), ~F.col("q_grade").eqNullSafe(F.col("own_grade"))
    kind = E.error_class(pool, place, function, ~function & ~subtype, subtype, F.col("q_material")[0] != F.col("own_material"))
    return c.select("query_id", "doc_id", kind.alias("error_class"))


@query("rank_outcomes", f"""WITH {RANKS}, p AS (SELECT query_id, min(rank) FILTER (system = 'initial') AS b, min(rank) FILTER (system = 'final') AS a FROM e GROUP BY ALL)
SELECT query_id, b AS before, a AS after, CASE WHEN b IS NOT DISTINCT FROM a THEN 'unchanged' WHEN a = 1 THEN 'fixed' WHEN b = 1 THEN 'regressed' WHEN a IS NULL OR a > b THEN 'worsened' ELSE 'improved' END AS outcome FROM p""")
def rank_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the expected document's rank from the initial to the final order."""
    results, cases = _results(spark, sf_dir)
    met = S.case_rows(results, cases, SYSTEMS).groupBy("query_id").pivot("system", ["initial", "final"]).agg(F.min("rank"))
    return met.select("query_id", F.col("initial").alias("before"), F.col("final").alias("after"), E.outcome(F.col("initial"), F.col("final")).alias("outcome"))


@query("scrubbed_texts", f"""WITH {BASE}, {N} SELECT id, CASE size % 4 WHEN 0 THEN name || ' to and , ' || size || ' mm' WHEN 1 THEN 'as ' || name WHEN 2 THEN name || ' this ' || size ELSE name || ' of ISO ' || size || '00' END AS text FROM n""")
def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which the codes of documents are taken out, and nothing that only looks like one."""
    p, size = parts(spark, sf_dir), F.col("size").cast("string")
    text = (
        F.when(F.col("size") % 4 == 0, F.concat("name", F.lit(" to IS 1239 (Part 1): 2004 and is/iec 60034, "), size, F.lit(" mm"))).when(F.col("size") % 4 == 1, F.concat(F.lit("IS:458 as "), "name", F.lit("  IS 3597")))
        .when(F.col("size") % 4 == 2, F.concat("name", F.lit(" this "), size)).otherwise(F.concat("name", F.lit(" of ISO "), size, F.lit("00")))
    )
    return p.select("id", I.scrub(text).alias("text"))


@query("metadata_templates", f"""WITH {BASE}, {N},
t AS (SELECT id, unnest(list_distinct(list_filter(['Need ' || name, 'Need ' || material || ' ' || name, CASE WHEN wants_use IS NOT NULL THEN name || ' for ' || wants_use END, CASE WHEN grade IS NOT NULL THEN 'grade ' || grade || ' ' || name END], lambda x: x IS NOT NULL))) AS query FROM n)
SELECT id AS doc_id, query FROM t QUALIFY row_number() OVER (PARTITION BY lower(query) ORDER BY id) = 1""")
def metadata_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from metadata in the order of their templates, codes and repeats left out."""
    p = parts(spark, sf_dir).withColumnRenamed("id", "doc_id")
    said = [F.concat(F.lit("Need "), "name"), F.concat(F.lit("Need "), "wants_material", F.lit(" "), "name"), F.concat("name", F.lit(" for "), "wants_use"), F.concat(F.lit("grade "), "grade", F.lit(" "), "name"), F.concat("name", F.lit(" to IS 1239")), F.lit(" ")]
    return I.templates(p, said).select("doc_id", "query")


@query("corpus_rows", f"""WITH {BASE}, {N} SELECT 'IS ' || id AS standard_id, 'is ' || id AS canonical_id, coalesce(CASE WHEN size % 3 <> 0 THEN name END, 'IS ' || id) AS title, CASE WHEN size % 2 = 0 THEN 1950 + size END::INT AS publication_year, 'parsed' AS source_dataset,
 'is ' || id AS source_record_id, '  ' || upper(name) || ' x' AS retrieval_text, name || ' x' AS normalized_retrieval_text FROM n""")
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed records as rows of the corpus."""
    p = parts(spark, sf_dir)
    base = {"standard_code": F.concat(F.lit("IS "), "id"), "standard_code_norm": F.concat(F.lit("is "), "id"), "title": F.when(F.col("size") % 3 != 0, F.col("name")), "scope": F.col("scope"), "retrieval_text": F.concat(F.lit("  "), F.upper("name"), F.lit(" x"))}
    base |= {"revision": F.when(F.col("size") % 2 == 0, F.concat(F.lit("Second revision: "), (F.col("size") + 1950).cast("string"))), "page_start": F.lit(1), "page_end": F.col("size"), "full_text": F.col("name")}
    lists, known = set(R.KEYWORD_LISTS), [*R.KEYWORDS, *R.KEYWORD_LISTS, *R.KEPT, *R.PROFILED]
    more = {k: F.array("name") if k in lists else F.lit(None).cast("string") for k in known if k not in base}
    out = R.whole_corpus(p.select(*(v.alias(k) for k, v in (base | more).items())), "parsed")
    return out.select("standard_id", "canonical_id", "title", "publication_year", "source_dataset", "source_record_id", "retrieval_text", "normalized_retrieval_text")


@query("frozen_phrases", f"""WITH {BASE}, {N} SELECT id, 'Covers ' || name || ' in use' AS scope_phrase, CASE WHEN size % 3 = 0 THEN 'is ' || id ELSE array_to_string(list_slice(string_split('all about the ' || name || ' of them', ' '), 1, 5), ' ') END AS title_phrase,
 'Covers ' || name || ' in use' || CASE WHEN size % 3 = 0 THEN '' ELSE ' (all about the ' || name || ' of them)' END AS description FROM n""")
def frozen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of scopes and titles, and both as a description."""
    p = parts(spark, sf_dir)
    scope, title = F.concat(F.lit("Covers  "), "name", F.lit("\nin use...")), F.when(F.col("size") % 3 != 0, F.concat(F.lit("All about  the "), "name", F.lit(" of them")))
    return p.select("id", R.scope_phrase(scope).alias("scope_phrase"), R.title_phrase(title, F.concat(F.lit("IS "), "id")).alias("title_phrase"), R.product_description(scope, title).alias("description"))


@query("shown_names", f"""WITH {BASE}, {N} SELECT id, CASE WHEN size % 3 = 0 THEN upper(substring(name, 1, 1)) || substring(name, 2) ELSE upper(substring(product, 1, 1)) || substring(replace(product, '_', ' '), 2) END AS shown,
 CASE WHEN size % 4 <> 0 THEN material END AS material FROM n""")
def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as shown, and materials that the source does not know as test equipment alone."""
    p = parts(spark, sf_dir)
    equipment = F.col("size") % 4 == 0
    material = D.validated_material(F.lit("of no stuff"), F.when(equipment, F.lit("steel")).otherwise(F.col("wants_material")), F.when(equipment, F.lit("dropped with a steel ball")).otherwise(F.lit("")))
    return p.select("id", D.product_name(F.when(F.col("size") % 3 == 0, F.col("name")), F.col("product")).alias("shown"), material.alias("material"))


@query("grouped_scores", """SELECT l_orderkey AS group_id, list(round(l_quantity / 2.0::DOUBLE, 6) ORDER BY l_linenumber, round(l_quantity / 2.0::DOUBLE, 6))::VARCHAR AS scores FROM lineitem GROUP BY l_orderkey""")
def grouped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch scores, given as lists of one, back in the order of each group's candidates."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("position"), F.array(F.round(F.col("l_quantity").cast("double") / 2, 6)).alias("raw"))
    out = R.by_group(R.scored(rows, F.col("raw")), "group_id", "position")
    return out.select("group_id", F.concat(F.lit("["), F.array_join(F.transform("scores", lambda x: x.cast("string")), ", "), F.lit("]")).alias("scores"))


@query("fact_places", f"""WITH {BASE}, {N}, t AS (SELECT id, size, length(name) AS n, size::VARCHAR AS s, (size + 5)::VARCHAR AS u, (size * 3)::VARCHAR AS c, size % 5 = 0 AS loose,
 name || ' of ' || size || ' x ' || (size + 5) || ' mm' || CASE WHEN size % 5 = 0 THEN ' with tolerance' ELSE '' END || ' kept at ' || size * 3 || ' C by 10.0.0.' || size AS text FROM n),
p AS (SELECT *, n + 4 AS b1, n + 4 + length(s) + 3 + length(u) + 3 AS e1, n + 4 + length(s) + 3 + length(u) + 3 + CASE WHEN loose THEN 15 ELSE 0 END + 9 AS b2 FROM t)
SELECT id, 'size' AS kind, s || ' × ' || u || ' mm' AS value, b1 AS "begin", e1 AS "end", text AS evidence FROM p WHERE NOT loose
UNION ALL SELECT id, 'temperature', c || ' C', b2, b2 + length(c) + 2, text FROM p UNION ALL SELECT id, 'address', '10.0.0.' || s, b2 + length(c) + 6, b2 + length(c) + 13 + length(s), text FROM p""")
def fact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their places and evidence; sizes beside a tolerance are none."""
    s = lambda c: c.cast("string")
    size = F.col("size")
    text = F.concat("name", F.lit(" of "), s(size), F.lit(" x "), s(size + 5), F.lit(" mm"), F.when(size % 5 == 0, " with tolerance").otherwise(""), F.lit(" kept at "), s(size * 3), F.lit(" C by 10.0.0."), s(size))
    found = parts(spark, sf_dir).select("id", F.explode(A.extract_facts(text)).alias("f")).select("id", "f.*")
    return found.withColumn("begin", F.col("begin").cast("long")).withColumn("end", F.col("end").cast("long"))
