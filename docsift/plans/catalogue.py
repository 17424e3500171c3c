"""The domain operators on texts, with oracles that never read a text.

Parts are a catalogue of documents: titles, scopes and materials are sentences made of a part's attributes, and orders are
requirements whose wish is the part of their first line and whose candidates are the others. The operators read the
sentences; the oracles tell what must come out from the attributes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.operators import constraints as C
from docsift.operators import intent as I
from docsift.operators import metadata as M
from docsift.operators import training as L
from docsift.operators.blocks import spread

from .registry import query

# What the words of a part stand for: noun to product, family, name in a text; type to material; attribute to use.
PRODUCTS = {
    "widget": ("pipe", "piping", "water pipes"), "ring": ("pipe_fitting", "piping", "pipe bends"), "bolt": ("valve", "valves", "gate valves"), "plate": ("roofing_tile", "roofing", "roofing tiles"),
    "rod": ("paver", "paving", "paving blocks"), "gear": ("lagging", "insulation", "lagging mats"), "gizmo": ("pump", "pumps", "centrifugal pumps"), "anvil": ("casing", "piping", "borewell casings"),
}
MATERIALS = {"STANDARD": ("HDPE", "plastic"), "ECONOMY": ("PVC", "plastic"), "MEDIUM": ("cast iron", "metal"), "LARGE": ("brass", "metal"), "PROMO": ("rock wool", "wool"), "SMALL": ("sandstone", "stone")}
USES = {
    "blue": ("potable water supply", "conveying potable water"), "cold": ("potable water supply", "drinking water lines"), "red": ("water pipeline", "a water pipeline"), "old": ("sewerage", "drainage and sewage"),
    "new": ("industrial waste", "industrial effluent"), "large": (None, "other than potable water"), "small": (None, "gardens"), "hot": (None, "steam service"),
}
KINDS = [("test_method", "Methods of test for %s"), ("code_of_practice", "Code of practice for %s"), ("terminology", "Glossary of terms on %s"), ("installation", "Laying of %s"), ("other", "All about %s"), ("other", "On %s")]


def _map(key: Column, table: dict, i: int) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v[i]))
    return out.otherwise(F.lit(None))


def _sql_map(key: str, table: dict, i: int) -> str:
    says = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {says(v[i])}" for k, v in table.items()) + " END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, scope, material, application, product, family, and what a requirement of this kind wants."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), always=True)
    word, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    grade = F.when(F.col("p_size") % 4 == 0, "33").when(F.col("p_size") % 4 == 1, "43").when(F.col("p_size") % 4 == 2, "53")
    material = _map(F.col("p_type"), MATERIALS, 0)
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), _map(noun, PRODUCTS, 0).alias("product"), _map(noun, PRODUCTS, 1).alias("family"), _map(noun, PRODUCTS, 2).alias("name"),
        F.concat(F.lit("made of "), material).alias("material"), material.alias("wants_material"), F.concat(F.lit("for "), _map(word, USES, 1)).alias("application"), _map(word, USES, 0).alias("wants_use"),
        F.concat_ws(" ", _map(noun, PRODUCTS, 2), F.concat(F.lit("of "), grade, F.lit(" grade"))).alias("title"), grade.alias("grade"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("serving up to "), F.col("p_size") * 12, F.lit(" degrees C"))).alias("scope"),
        F.when(word.isin("hot", "cold"), F.col("p_size") * 10.0).alias("wants_temperature"), F.when(F.col("p_size") % 5 == 0, "brass").alias("unwanted"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns for constraints.score: the order's other lines against the wish of its first."""
    p, lines = parts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.groupBy(F.col("l_orderkey").alias("query_id"), "l_partkey").agg(F.min("l_linenumber").alias("line"))
    by_place = Window.partitionBy("query_id").orderBy("line", "l_partkey")
    lines = lines.select("query_id", "l_partkey", F.row_number().over(by_place).cast("long").alias("rank"), F.first("l_partkey").over(by_place).alias("wish"))
    asked = p.select(
        F.col("id").alias("wish"), F.col("product").alias("q_product"), F.col("family").alias("q_family"), F.array("wants_material").alias("q_material"), F.array("wants_use").alias("q_application"),
        F.array("unwanted").alias("q_excluded_material"), F.col("grade").alias("q_grade"), F.col("wants_temperature").alias("q_temperature_c"),
    )
    # Texts are read on both sides, a part at a time, before the pairs are made; documents join last, so that their texts move once.
    pairs = lines.where("rank > 1").join(C.asked(asked), "wish").drop("wish")
    return pairs.join(C.prepared(p.withColumnRenamed("id", "l_partkey")), "l_partkey").withColumnRenamed("l_partkey", "doc_id")


_W, _N = "string_split(p_name, ' ')[1]", "string_split(p_name, ' ')[2]"
BASE = f"""a AS (SELECT p_partkey AS id, p_size AS size, {_W} AS word, {_sql_map(_N, PRODUCTS, 0)} AS product, {_sql_map(_N, PRODUCTS, 1)} AS family, {_sql_map("p_type", MATERIALS, 0)} AS material,
 {_sql_map("p_type", MATERIALS, 1)} AS stuff, {_sql_map(_W, USES, 0)} AS wants_use, CASE p_size % 4 WHEN 0 THEN '33' WHEN 1 THEN '43' WHEN 2 THEN '53' END AS grade FROM part),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY line, doc_id) AS rank FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)),
c AS (SELECT d.query_id, d.doc_id, d.rank, x, y FROM l q JOIN a x ON x.id = q.doc_id JOIN l d ON d.query_id = q.query_id JOIN a y ON y.id = d.doc_id WHERE q.rank = 1 AND d.rank > 1),
s AS (SELECT query_id, doc_id, rank,
 CASE WHEN x.product = y.product THEN 'compatible' WHEN (x.product, y.product) IN (('pipe', 'pipe_fitting'), ('pipe_fitting', 'pipe')) THEN 'adjacent' WHEN x.family = y.family THEN 'same_family' ELSE 'incompatible' END AS compatibility,
 CASE WHEN x.material = y.material THEN 'EXACT_MATCH' WHEN x.stuff = y.stuff THEN 'STRONG_COMPATIBLE' ELSE 'CONTRADICTION' END AS material_state,
 CASE WHEN x.wants_use IS NULL THEN NULL WHEN x.wants_use = 'potable water supply' THEN CASE WHEN y.word IN ('blue', 'cold') THEN 'STRONG_COMPATIBLE' WHEN y.word = 'large' THEN 'CONTRADICTION' ELSE 'UNKNOWN' END
  WHEN x.wants_use = 'water pipeline' THEN CASE WHEN y.word = 'red' THEN 'EXACT_MATCH' WHEN y.word IN ('blue', 'cold', 'large') OR y.product = 'pipe' THEN 'PARTIAL_MATCH' ELSE 'UNKNOWN' END
  WHEN x.wants_use = 'sewerage' THEN CASE WHEN y.word = 'old' THEN 'STRONG_COMPATIBLE' ELSE 'UNKNOWN' END
  ELSE CASE WHEN y.word IN ('new', 'large') THEN 'STRONG_COMPATIBLE' ELSE 'UNKNOWN' END END AS use_state,
 CASE WHEN x.size % 5 <> 0 THEN NULL WHEN y.stuff = 'metal' THEN 'CONTRADICTION' ELSE 'CLEAR' END AS excluded,
 CASE WHEN x.grade IS NULL THEN NULL WHEN y.grade IS NULL THEN 'UNKNOWN' WHEN x.grade = y.grade THEN 'MATCH' ELSE 'CONTRADICTION' END AS grade_state,
 CASE WHEN x.word NOT IN ('hot', 'cold') THEN NULL WHEN y.size % 2 = 1 THEN 'UNKNOWN' WHEN x.size * 10 <= y.size * 12 THEN 'MATCH' ELSE 'CONTRADICTION' END AS heat_state FROM c),
w AS (SELECT *, CAST(CASE compatibility WHEN 'compatible' THEN 8 WHEN 'adjacent' THEN 2 WHEN 'same_family' THEN 0.75 ELSE -10 END
 + CASE material_state WHEN 'EXACT_MATCH' THEN 4 WHEN 'STRONG_COMPATIBLE' THEN 3 ELSE -8 END
 + CASE coalesce(use_state, 'UNKNOWN') WHEN 'EXACT_MATCH' THEN 4 WHEN 'STRONG_COMPATIBLE' THEN 3 WHEN 'PARTIAL_MATCH' THEN 1.5 WHEN 'CONTRADICTION' THEN -8 ELSE 0 END
 + CASE WHEN excluded = 'CONTRADICTION' THEN -8 ELSE 0 END + CASE grade_state WHEN 'MATCH' THEN 4 WHEN 'CONTRADICTION' THEN -8 ELSE 0 END
 + CASE heat_state WHEN 'MATCH' THEN 4 WHEN 'CONTRADICTION' THEN -8 ELSE 0 END AS DOUBLE) AS constraint_score FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score(candidates(spark, sf_dir))


@query("product_compatibility", f"WITH {BASE} SELECT query_id, doc_id, rank, compatibility FROM s")
def product_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    fit = C.compatibility(F.col("q_product"), F.col("product"), F.col("q_family"), F.col("family"))
    return candidates(spark, sf_dir).select("query_id", "doc_id", "rank", fit.alias("compatibility"))


@query("product_gate", f"WITH {BASE} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY compatibility = 'incompatible', rank) AS gated_rank FROM s")
def product_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return C.gate(product_compatibility(spark, sf_dir), F.col("compatibility")).select("query_id", "doc_id", F.col("gated_rank").cast("long").alias("gated_rank"))


@query("constraint_score", f"""WITH {BASE} SELECT query_id, doc_id, rank, constraint_score, concat_ws(',', 'PRODUCT_' || CASE compatibility WHEN 'compatible' THEN 'EXACT_PRODUCT' WHEN 'adjacent' THEN 'ADJACENT_PRODUCT' WHEN 'same_family' THEN 'SAME_FAMILY' ELSE 'CONTRADICTION' END,
 'MATERIAL_' || material_state, 'APPLICATION_' || use_state, 'EXCLUDED_MATERIAL_' || excluded, 'GRADE_' || grade_state, 'TEMPERATURE_' || heat_state) AS flags FROM w""")
def constraint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States, scores and flags of every candidate."""
    return _scored(spark, sf_dir).select("query_id", "doc_id", "rank", "constraint_score", F.array_join("flags", ",").alias("flags"))


@query("constraint_order", f"WITH {BASE} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY least(constraint_score, 0) DESC, constraint_score DESC, rank) AS constraint_rank FROM w")
def constraint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return C.order(_scored(spark, sf_dir)).select("query_id", "doc_id", F.col("constraint_rank").cast("long").alias("constraint_rank"))


@query("final_order", f"""WITH {BASE} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank) + constraint_score, 6) AS final_score,
 row_number() OVER (PARTITION BY query_id ORDER BY constraint_score < 0, 1.0::DOUBLE / (60 + rank) + constraint_score DESC, rank) AS final_rank FROM w""")
def final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, D21."""
    rows = _scored(spark, sf_dir).withColumn("rrf_score", 1.0 / (60 + F.col("rank")))
    return C.final_order(rows).select("query_id", "doc_id", F.round("final_score", 6).alias("final_score"), F.col("final_rank").cast("long").alias("final_rank"))


def _state(name: str, column: str, how, sql: str, doc: str) -> None:
    @query(name, f"WITH {BASE} SELECT query_id, doc_id, rank, {sql} AS {column} FROM s")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return candidates(spark, sf_dir).select("query_id", "doc_id", "rank", how().alias(column))

    run.__doc__ = doc


_state("material_state", "state", lambda: C.material_state(F.col("q_material")[0], F.col("material")), "material_state", "D17")
_state("text_state", "flag", lambda: C.attribute(F.col("q_application"), F.concat_ws(" ", "application", "title"), "APPLICATION", C.text_state)[1], "'APPLICATION_' || use_state", "D15, D18")
_state("exclusion_score", "flag", lambda: C.exclusion(F.col("q_excluded_material"), F.col("material"), "MATERIAL", C.material_state)[1], "'EXCLUDED_MATERIAL_' || excluded", "D16")
_state("grade_state", "flag", lambda: C.grade(F.col("q_grade"), F.col("title"))[1], "'GRADE_' || grade_state", "D19")
_state("temperature_ranges", "flag", lambda: C.temperature(F.col("q_temperature_c"), F.coalesce("scope", F.lit("")))[1], "'TEMPERATURE_' || heat_state", "D20")


def _aliases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(p, phrase, i) for i, (p, _, phrase) in enumerate(PRODUCTS.values())]
    return spark.createDataFrame(rows, "product string, phrase string, ord int"), spark.createDataFrame([(p, f) for p, f, _ in PRODUCTS.values()], "product string, family string")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, scope, summary, full_text: titles of several kinds of documents; some scopes, and every full text, name pumps too."""
    p, title = parts(spark, sf_dir), F
    for i, (_, phrase) in enumerate(KINDS):
        title = title.when(F.col("size") % len(KINDS) == i, F.format_string(phrase, "name"))
    scope = F.when(F.col("size") % 4 == 0, F.concat(F.lit("This tells of "), "name", F.lit(" and of centrifugal pumps")))
    return p.select("id", title.alias("title"), scope.alias("scope"), F.lit(None).cast("string").alias("summary"), F.concat(F.lit("Centrifugal pumps, "), "material").alias("full_text"))


KIND_SQL = "CASE size % 6 WHEN 0 THEN 'test_method' WHEN 1 THEN 'code_of_practice' WHEN 2 THEN 'terminology' WHEN 3 THEN 'installation' ELSE 'other' END"
# A title is worth 3, a scope 2, the full text 1: the product has 3 or 5, pumps beside it 1 or 3, and pumps alone 4 or 6.
SCORES = f"""r AS (SELECT id, {KIND_SQL} AS kind, product, family, size % 4 = 0 AS scoped, CASE WHEN product = 'pump' THEN CASE WHEN size % 4 = 0 THEN 6 ELSE 4 END WHEN size % 4 = 0 THEN 5 ELSE 3 END AS score,
 CASE WHEN product = 'pump' THEN 0 WHEN size % 4 = 0 THEN 3 ELSE 1 END AS runner_up FROM a)"""


@query("kind_cascade", f"WITH {BASE} SELECT id, {KIND_SQL} AS kind FROM a")
def kind_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return records(spark, sf_dir).select("id", M.kind(F.col("title"), F.col("scope")).alias("kind"))


@query("product_canonicalize", f"WITH {BASE}, {SCORES} SELECT id, product, score, runner_up, CASE WHEN score >= runner_up + 2 THEN 'high' ELSE 'low' END AS confidence FROM r")
def product_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases in titles, scopes and texts, and the margin of the best."""
    found = M.products(records(spark, sf_dir), _aliases(spark)[0])
    return found.select("id", "product", F.col("score").cast("long").alias("score"), F.col("runner_up").cast("long").alias("runner_up"), "confidence")


@query("metadata_derive", f"""WITH {BASE}, {SCORES} SELECT r.id, kind AS standard_kind, CASE WHEN kind = 'other' THEN r.product END AS product, CASE WHEN kind = 'other' THEN r.family END AS family, 'high' AS confidence,
 list_aggregate(list_sort(list_distinct(CASE WHEN scoped THEN [r.family, 'pumps'] ELSE [r.family] END)), 'string_agg', ',') AS applies_to, material FROM r JOIN a USING (id)""")
def metadata_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is no product keeps the family as one it applies to."""
    aliases, families = _aliases(spark)
    patterns = spark.createDataFrame([("material", m, m, i, False) for i, (m, _) in enumerate(MATERIALS.values())], "field string, value string, phrase string, ord int, headings_only boolean")
    out = M.derive(records(spark, sf_dir), aliases, families, patterns, ["of", "on", "for", "all", "about"])
    return out.select("id", "standard_kind", "product", "family", "confidence", F.array_join("applies_to", ",").alias("applies_to"), "material")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: what is needed, of what, for what, what not, and on what it stands."""
    p = parts(spark, sf_dir)
    text = F.concat_ws(" ", F.lit("need"), "name", F.col("material"), F.concat(F.lit("for "), "wants_use"), F.concat(F.lit("grade "), "grade"), F.concat(F.lit("at "), F.col("wants_temperature").cast("int"), F.lit(" C")), F.concat(F.lit("; not "), "unwanted"))
    return p.select(F.col("id").alias("query_id"), text.alias("text"))


@query("intent_normalize", f"""WITH {BASE} SELECT id AS query_id, CASE WHEN size % 5 = 0 AND material = 'brass' THEN '' ELSE material END AS material, CASE WHEN size % 5 = 0 THEN 'brass' ELSE '' END AS excluded,
 coalesce(wants_use, '') AS application, product, grade, CAST(CASE WHEN word IN ('hot', 'cold') THEN size * 10 END AS DOUBLE) AS temperature_c FROM a""")
def intent_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded values, what is negated (and so not wanted), grade and temperature of a requirement's text."""
    rows = [("material", m, m, i) for i, (m, _) in enumerate(MATERIALS.values())] + [("application", u, u, i) for i, u in enumerate(sorted({u for u, _ in USES.values() if u}))] + [("product", p, n, i) for i, (p, _, n) in enumerate(PRODUCTS.values())]
    out = I.intents(requirements(spark, sf_dir), spark.createDataFrame(rows, "field string, value string, phrase string, ord int"))
    say = lambda c: F.array_join(c, ",")
    return out.select("query_id", say("q_material").alias("material"), say("q_excluded_material").alias("excluded"), say("q_application").alias("application"), say("q_product").alias("product"), F.col("q_grade").alias("grade"), F.col("q_temperature_c").alias("temperature_c"))


# What a requirement says by size % 6: of its surroundings, of what it must not be, of reverse flow, of fastening (with and without a word that grounds it), of a medium.
SAYINGS = [" on the brass water line", ", not PVC", " that lets no water come back", " to hold steelwork", " to hold steelwork at a joint", " without potable supply"]


@query("intent_grounding", f"""WITH {BASE}, n AS (SELECT *, size % 6 AS k FROM a)
SELECT id AS query_id, product, CASE WHEN k = 1 AND material = 'PVC' THEN '' ELSE material END AS material, CASE WHEN k = 1 THEN 'PVC' ELSE '' END AS excluded_material, CASE WHEN k = 0 THEN 'brass' ELSE '' END AS context_material,
 CASE WHEN product = 'pipe' AND k <> 2 OR product = 'valve' AND k = 2 THEN 'water' ELSE '' END AS medium, CASE WHEN k = 5 THEN 'potable water' ELSE '' END AS excluded_medium, CASE WHEN k = 0 THEN 'water' ELSE '' END AS context_medium,
 CASE k WHEN 2 THEN 'prevent_reverse_flow' WHEN 4 THEN 'structural_fastening' ELSE '' END AS "function" FROM n""")
def intent_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention in its innermost scope, the surroundings apart, functions grounded, no reverse flow excluded from valves."""
    rows = [("material", m, m, i) for i, (m, _) in enumerate(MATERIALS.values())] + [("product", p, n, i) for i, (p, _, n) in enumerate(PRODUCTS.values())]
    rows += [("medium", "water", "water", 0), ("medium", "potable", "potable", 1), ("function", "structural_fastening", "hold steelwork", 0), ("function", "prevent_reverse_flow", "non return", 1)]
    says = F
    for i, x in enumerate(SAYINGS):
        says = says.when(F.col("size") % 6 == i, F.lit(x))
    queries = parts(spark, sf_dir).select(F.col("id").alias("query_id"), F.concat(F.lit("need "), "name", F.lit(" of "), "wants_material", says).alias("text"))
    out = I.intents(queries, spark.createDataFrame(rows, "field string, value string, phrase string, ord int"))
    named = {"product": "q_product", "material": "q_material", "excluded_material": "q_excluded_material", "context_material": "context_material", "medium": "q_medium", "excluded_medium": "q_excluded_medium", "context_medium": "context_medium", "function": "q_function"}
    return out.select("query_id", *(F.array_join(c, ",").alias(name) for name, c in named.items()))


@query("field_evidence", f"""WITH {BASE} SELECT id, product, CASE WHEN size % 4 = 0 AND product = 'pump' THEN 'title,scope' WHEN size % 4 = 0 THEN 'title,scope' ELSE 'title' END AS evidence FROM a""")
def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources in which an alias of the product stands."""
    return M.products(records(spark, sf_dir), _aliases(spark)[0]).select("id", "product", F.array_join("evidence", ",").alias("evidence"))


@query("split_items", f"""WITH {BASE}, n AS (SELECT p_partkey AS id, p_name, p_size % 5 AS k, unnest(range(0, p_size % 5 + 1)) AS i FROM part)
SELECT id AS doc_id, CAST(i + 1 AS INT) AS item, 'Item ' || (i + 1) || ': ' || p_name || ' no ' || i AS text FROM n""")
def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their headers, numbered by their place."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(": "), "p_name", F.lit(" no "), i.cast("string")))
    return I.items(p.select(F.col("p_partkey").alias("doc_id"), F.array_join(lines, "\n").alias("text"))).select("doc_id", F.col("item").cast("int").alias("item"), "text")


@query("training_split", """SELECT p_partkey, CASE WHEN ('0x' || substring(md5('5108:' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15 THEN 'validation' ELSE 'train' END AS split FROM part""")
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: a hash of seed and key decides, row by row."""
    return L.split(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")


@query("training_pair_violations", """WITH p AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS label FROM lineitem),
g AS (SELECT query_id, sum(label) AS pos, count(*) FILTER (label = 0) AS neg FROM p GROUP BY 1), t AS (SELECT query_id, doc_id, count(*) AS n, count(DISTINCT label) AS k FROM p GROUP BY 1, 2)
SELECT 'not_one_positive' AS rule, query_id FROM g WHERE pos <> 1 UNION SELECT 'no_negatives', query_id FROM g WHERE neg = 0 UNION SELECT 'duplicate_pair', query_id FROM t WHERE n > 1
UNION SELECT 'positive_as_negative', query_id FROM t WHERE k > 1 UNION SELECT 'missing_document', query_id FROM p ANTI JOIN part ON p_partkey = doc_id""")
def training_pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, their first line as the positive."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lines.select(F.col("l_orderkey").alias("query_id"), F.lit("q").alias("query"), F.col("l_partkey").alias("doc_id"), F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("label"))
    return L.pair_violations(pairs, spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id")))
