"""Tender items and technical facts: the operators read sentences made of a part's attributes, the oracles the attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import details as D
from docsift.operators import effective as E
from docsift.operators import mapping as R
from docsift.operators import tender as X
from docsift.operators.blocks import spread

from .registry import query

# A part's noun: what a tender writes, the product, the material, the function.
GOODS = {
    "widget": ("upvc pipe", "UPVC pipe", "UPVC", None), "ring": ("HDPE pipe", "HDPE pipe", "HDPE", None), "bolt": ("mild steel hexagonal bolt", "hexagonal bolt", "steel", "fastening"), "plate": ("clay tile", "tile", "clay", None),
    "rod": ("OPC", "ordinary Portland cement", None, None), "gear": ("pressure reducing valve", "pressure reducing valve", None, "reduce_pressure"), "gizmo": ("pump", "pump", None, None), "anvil": ("gate valve", "valve", None, None),
}
# Its first word: what a tender writes, the applications, function, installation, exclusion.
PLACES = {
    "blue": (" for potable mains", "potable water supply", None, None, None), "cold": (" for gravity drainage of soil in a building", "soil drainage,building drainage", "gravity drainage", "building drainage", None),
    "red": (" for rainwater", "rainwater drainage", None, None, None), "old": (" for sewage", "sewerage", None, None, None), "new": (" for flooring", "flooring", None, None, None),
    "large": (", not roofing", None, None, None, "roofing"), "small": (", underground", None, None, "underground", None), "hot": ("", None, None, None, None),
}


def _rows(table: dict) -> str:
    says = lambda v: "NULL" if v is None else "'" + v + "'"
    return ", ".join(f"('{k}', {', '.join(map(says, v))})" for k, v in table.items())


def _told(key: Column, table: dict) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v[0]))
    return out


TENDER = f"""WITH g AS (SELECT * FROM (VALUES {_rows(GOODS)}) AS t(noun, written, product, material, job)),
 u AS (SELECT * FROM (VALUES {_rows(PLACES)}) AS t(word, place, uses, job2, site, unwanted)),
 a AS (SELECT p_partkey, p_size, g.*, u.*, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.5' END AS mm, CASE WHEN p_size % 2 = 0 THEN 'of diameter ' || p_size || ' mm' ELSE 'of ' || p_size || '.50 mm nominal diameter' END AS written_mm
  FROM part JOIN g ON g.noun = string_split(p_name, ' ')[2] JOIN u ON u.word = string_split(p_name, ' ')[1]),
 b AS (SELECT *, CASE WHEN noun = 'widget' AND word = 'cold' THEN 'UPVC drainage pipe' ELSE product END AS what, concat_ws(',', job2, CASE WHEN job = 'reduce_pressure' THEN job END, CASE WHEN job = 'fastening' THEN job END) AS jobs FROM a)
 SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS item_no, what AS product, coalesce(material, '') AS material, coalesce(uses, '') AS application, jobs AS functions, coalesce(site, '') AS installation, 'bends' AS components, coalesce(unwanted, '') AS excluded,
  'corrosion' AS requirements, p_size + CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE 0.5 END AS diameter_mm, noun = 'anvil' AND uses IS NULL AND jobs = '' AS ambiguity,
  concat_ws(', ', what, material, replace(uses, ',', ', '), nullif(replace(jobs, ',', ', '), ''), CASE WHEN site = 'underground' THEN site END, mm || ' mm nominal diameter',
   CASE WHEN uses IS NULL AND jobs = '' THEN 'Item ' || p_partkey || ': ' || written || ' ' || written_mm || place || '. Resists corrosion, with bends.' END) AS description
 FROM b"""


@query("tender_extract", TENDER)
def tender_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tender's item for each part."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), always=True)
    word, noun, size = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_size").cast("string")
    mm = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("of diameter "), size, F.lit(" mm"))).otherwise(F.concat(F.lit("of "), size, F.lit(".50 mm nominal diameter")))
    text = F.concat(F.lit("Item "), F.col("p_partkey").cast("string"), F.lit(": Supply "), _told(noun, GOODS), F.lit(" "), mm, _told(word, PLACES), F.lit(". Resists corrosion, with bends."))
    told = X.extract(p.select("p_partkey", text.alias("text")))
    joined = [F.array_join(c, ",").alias(name) for c, name in (("material", "material"), ("application", "application"), ("function", "functions"), ("installation", "installation"), ("components", "components"), ("excluded", "excluded"), ("requirements", "requirements"))]
    return told.select("p_partkey", "item_no", "product", *joined, "diameter_mm", "ambiguity", "description")


DETAIL = """WITH t AS (SELECT p_partkey, p_size AS s, string_split(p_name, ' ')[1] AS word FROM part)
 SELECT p_partkey, 'NOMINAL_SIZE' AS kind, 'Nominal size' AS name, s || ' × ' || (s + 5) || ' mm' AS value, 'mm' AS unit FROM t
 UNION ALL SELECT p_partkey, 'MAXIMUM_LIMIT', 'Warpage', 'maximum 1.5 percent along edges; maximum ' || s || ' percent along diagonals', 'percent' FROM t WHERE s % 3 = 0
 UNION ALL SELECT p_partkey, 'OTHER_REQUIREMENT', 'Limit', 'Warpage shall not exceed 1.5 percent along edges and ' || s || ' percent along diagonals.', NULL FROM t WHERE s % 3 = 0
 UNION ALL SELECT p_partkey, 'TEMPERATURE_LIMIT', 'Maximum temperature', CAST(s * 3 AS VARCHAR), 'C' FROM t WHERE word IN ('hot', 'cold')
 UNION ALL SELECT p_partkey, 'TEMPERATURE_LIMIT', 'Temperature', s * 3 || ' C', 'C' FROM t WHERE word IN ('hot', 'cold')
 UNION ALL SELECT p_partkey, 'GRADE', 'Grade/Class', 'Grade ' || s, NULL FROM t WHERE s % 4 = 0
 UNION ALL SELECT p_partkey, 'OTHER_REQUIREMENT', 'Compressive strength', 'The compressive strength shall be ' || s || ' units.', NULL FROM t WHERE s % 5 = 0"""


@query("detail_extract", DETAIL)
def detail_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a part's technical text."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), always=True)
    s, word = F.col("p_size"), F.split("p_name", " ")[0]
    text = F.concat_ws(
        " ",
        F.concat(F.lit("The nominal size is "), s.cast("string"), F.lit("X"), (s + 5).cast("string"), F.lit(" mm here, as made by all.")),
        F.when(s % 3 == 0, F.concat(F.lit("Warpage shall not exceed 1.5 percent along edges and "), s.cast("string"), F.lit(" percent along diagonals."))),
        F.when(word.isin("hot", "cold"), F.concat(F.lit("Service temperature up to "), (s * 3).cast("string"), F.lit(" °C."))),
        F.when(s % 4 == 0, F.concat(F.lit("grade "), s.cast("string"), F.lit("."))),
        F.when(s % 5 == 0, F.concat(F.lit("The compressive strength shall be "), s.cast("string"), F.lit(" units."))),
    )
    told = p.select("p_partkey", F.explode(D.extract_details(text)).alias("f"))
    return told.select("p_partkey", "f.kind", "f.name", "f.value", "f.unit")


NORM = "'IS ' || p_partkey || CASE WHEN p_size % 3 = 0 THEN ' (PART ' || p_size || ')' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' SEC 2' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ':' || (1950 + p_size) ELSE '' END"


@query(
    "curated_rows",
    f"""SELECT {NORM} AS canonical_id, CASE WHEN p_partkey BETWEEN 10 AND 999999 THEN 'IS ' || p_partkey ELSE {NORM} END AS base_code, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS part,
 CASE WHEN p_size % 5 = 0 THEN '2' END AS section, CASE WHEN p_size % 2 = 0 THEN 1950 + p_size END AS publication_year, CASE WHEN p_size % 7 = 0 THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status,
 array_to_string(list_sort(list_distinct([lower(p_type), lower(p_brand)])), ',') AS keywords, lower(p_name) AS normalized_retrieval_text FROM part""",
)
def curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of a curated dataset."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("string")
    code = F.concat(
        F.lit("is "), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" (part "), size, F.lit(")"))).otherwise(""), F.when(F.col("p_size") % 5 == 0, " sec 2").otherwise(""),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" : "), (F.col("p_size") + 1950).cast("string"))).otherwise(""),
    )
    none = F.lit(None).cast("string")
    records = p.select(
        code.alias("standard_code"), F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.col("p_type").alias("source_scope"), F.when(F.col("p_size") % 7 == 0, "ACTIVE").alias("lifecycle_status"),
        none.alias("lifecycle_status_note"), none.alias("source_revision"), F.lit(1).alias("source_page_start"), F.col("p_size").alias("source_page_end"), F.concat(F.lit("  "), F.upper("p_name")).alias("retrieval_text"),
        F.col("p_name").alias("full_text"), F.array("p_type", F.lit(" ")).alias("product_family"), F.array("p_type", "p_brand").alias("applications"), F.lit(None).cast("array<string>").alias("materials"),
    )
    rows = R.curated(records, "parts")
    return rows.select("canonical_id", "base_code", "part", "section", "publication_year", "status", F.array_join("keywords", ",").alias("keywords"), "normalized_retrieval_text")


# What a part's noun and first word say in a document, and in a requirement.
TITLES = {
    "widget": "glass fibre reinforced pipes", "ring": "reflux valves", "bolt": "pressure reducing valves", "plate": "cement, part 1 fly ash based", "rod": "cement, Part 2 calcined_clay based",
    "gear": "preformed fibrous pipe insulation", "gizmo": "clay flooring tiles", "anvil": "anvils",
}
SCOPES = {"blue": "for Potable  water", "cold": "for sewage", "red": "for roofing"}
NEEDS = {
    "widget": "must not let water come  back", "ring": "of the Non-Return type", "bolt": "with a pressure regulator", "plate": "shall release air, OPC", "rod": "air relief on fly_ash, PPC", "gear": "pre-formed mats",
    "gizmo": "hexagon heads", "anvil": "Portland pozzolana of calcined  clay",
}


def _named(key: Column, table: dict) -> Column:
    return E.mapped(key, table)


def stored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents with stored metadata, and texts that tell other values."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    stored = {"canonical_product": "stored", "family": "stored family", "material": "brass", "application": "any", "function": "hold"}
    return p.select(
        "p_partkey", F.concat(F.lit("code "), F.col("p_partkey").cast("string")).alias("standard_id"), _named(F.split("p_name", " ")[1], TITLES).alias("title"), _named(F.split("p_name", " ")[0], SCOPES).alias("scope_text"),
        F.lit(None).cast("string").alias("retrieval_text"), F.when(F.col("p_size") % 2 == 0, "ordinary_portland_43").alias("product_subtype"), F.col("p_name").alias("primary_subject"), *(F.lit(v).alias(k) for k, v in stored.items()),
    )


@query(
    "effective_values",
    """WITH a AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS word, string_split(p_name, ' ')[2] AS noun, p_size % 2 = 0 AS even FROM part),
 b AS (SELECT *, CASE noun WHEN 'widget' THEN 'pipe' WHEN 'ring' THEN 'valve' ELSE 'stored' END AS product,
  CASE noun WHEN 'bolt' THEN 'pressure_reducing_valve' WHEN 'ring' THEN 'check_valve' WHEN 'plate' THEN 'portland_pozzolana_fly_ash' WHEN 'rod' THEN 'portland_pozzolana_calcined_clay' ELSE CASE WHEN even THEN 'ordinary_portland_43' END END AS subtype,
  CASE WHEN word = 'blue' THEN 'potable water supply' WHEN word = 'cold' THEN 'sewerage' WHEN noun = 'gizmo' AND word = 'red' THEN 'flooring roofing' WHEN noun = 'gizmo' THEN 'flooring' WHEN word = 'red' THEN 'roofing'
   WHEN noun = 'gear' THEN 'thermal insulation' ELSE 'any' END AS application FROM a)
 SELECT p_partkey, product AS canonical_product, CASE product WHEN 'pipe' THEN 'pipe_water_drainage' WHEN 'valve' THEN 'water_valve' ELSE 'stored family' END AS family, subtype AS product_subtype,
  CASE WHEN noun = 'ring' THEN 'check_valve' END AS subtype_family, CASE WHEN noun IN ('plate', 'rod') THEN 'ppc' WHEN even AND noun NOT IN ('bolt', 'ring') THEN 'opc' END AS cement_type,
  CASE noun WHEN 'plate' THEN 'fly_ash' WHEN 'rod' THEN 'calcined_clay' END AS pozzolana_source, CASE noun WHEN 'widget' THEN 'GRP' WHEN 'gear' THEN 'fibrous' WHEN 'gizmo' THEN 'clay' ELSE 'brass' END AS material, application,
  CASE WHEN noun = 'bolt' THEN 'reduce_pressure' WHEN noun = 'ring' THEN 'prevent_reverse_flow' WHEN application = 'potable water supply' THEN 'carry_potable_water' WHEN application = 'sewerage' THEN 'carry_sewage'
   WHEN application IN ('flooring', 'roofing') THEN application ELSE 'hold' END AS "function", coalesce(replace(subtype, '_', ' '), p_name) AS primary_subject, CASE WHEN noun = 'gear' THEN 'preformed' END AS form FROM b""",
)
def effective_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven fields from what a text says, else as stored."""
    docs = stored_docs(spark, sf_dir)
    return E.effective(docs).select("p_partkey", *(F.col(f"effective_{f}").alias(f) for f in E.FIELDS))


@query(
    "description_function",
    "SELECT p_partkey, CASE string_split(p_name, ' ')[2] WHEN 'widget' THEN 'prevent_reverse_flow' WHEN 'ring' THEN 'prevent_reverse_flow' WHEN 'bolt' THEN 'reduce_pressure' WHEN 'plate' THEN 'release_air' WHEN 'rod' THEN 'release_air' END AS target_function FROM part",
)
def description_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", E.description_function(_named(F.split("p_name", " ")[1], NEEDS)).alias("target_function"))


@query(
    "intent_enums",
    """SELECT p_partkey, CASE noun WHEN 'plate' THEN 'opc' WHEN 'rod' THEN 'ppc' WHEN 'anvil' THEN 'ppc' END AS cement_type, CASE noun WHEN 'rod' THEN 'fly_ash' WHEN 'anvil' THEN 'calcined_clay' END AS pozzolana_source,
 CASE WHEN noun = 'gizmo' THEN 'hexagonal' ELSE word END AS head_shape, CASE WHEN noun = 'gear' THEN 'preformed' END AS form, CASE WHEN noun = 'ring' AND p_size % 2 = 0 THEN 'check_valve' END AS subtype_family
 FROM (SELECT p_partkey, p_size, string_split(p_name, ' ')[1] AS word, string_split(p_name, ' ')[2] AS noun FROM part) AS a""",
)
def intent_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enums of a requirement from its words."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    word, noun, none = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.lit(None).cast("string")
    needs = _named(noun, NEEDS)
    return p.select(
        "p_partkey", E.cement_type(none, needs, none).alias("cement_type"), E.pozzolana_source(none, needs, none).alias("pozzolana_source"), E.head_shape(word, needs).alias("head_shape"), E.form(F.lit(" "), needs).alias("form"),
        E.subtype_family(needs, F.when(F.col("p_size") % 2 == 0, "valve").otherwise("pipe"), ["non return", "reflux"]).alias("subtype_family"),
    )
