"""Items of a tender: product, attributes, dimensions, a description of them and the sentences that say so.

All rules are tables of cues over Column expressions, so that extraction runs inside the JVM. Null and blank texts give no item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Products in deciding order, each with alternatives of cues that must all stand in the text.
PRODUCTS = [
    ("UPVC drainage pipe", [("upvc", "pipe", "drain")]), ("UPVC pipe", [("upvc", "pipe")]), ("HDPE pipe", [("hdpe", "pipe")]),
    ("ordinary Portland cement", [("ordinary portland cement",), (r"\bopc\b",)]), ("Portland pozzolana cement", [("portland pozzolana",), (r"\bppc\b",)]),
    ("cement", [("cement",)]), ("hexagonal bolt", [("hexagonal", "bolt")]), ("bolt", [("bolt",)]), ("pressure reducing valve", [("pressure", "valve", "reduc(?:ing|e)")]),
    ("valve", [("valve",)]), ("tile", [("tile",)]), ("pipe", [("pipe",)]),
]
# Words of a tender that name no product, and those that a description leaves out.
NO_PRODUCT = ["supply", "delivery", "installation", "contractor", "provide", "new", "material", "item"]
NOISE = r"(?i)\b(?:supply|delivery|installation|contractor|payment|completion|new material|free from defects)\b"
# Attribute values in the order they are told, and their cues (any of them, or all of a tuple).
MATERIALS = [
    ("UPVC", ["upvc", "unplasticized polyvinyl chloride", "unplasticised polyvinyl chloride"]), ("HDPE", ["hdpe", "high density polyethylene"]), ("PVC", [" pvc ", "polyvinyl chloride"]),
    ("fly ash", ["fly ash", "flyash"]), ("calcined clay", ["calcined clay"]), ("clay", ["clay"]), ("steel", ["steel"]),
]
APPLICATIONS = [
    ("soil drainage", ["soil"]), ("waste drainage", ["waste"]), ("rainwater drainage", ["rainwater"]), ("sewerage", ["sewage", "sewerage"]),
    ("potable water supply", ["potable", "drinking water"]), ("flooring", ["flooring"]), ("roofing", ["roofing"]),
]
NOT_ROOFING = ("not roofing", "excluding roofing")
FUNCTIONS = [
    ("gravity drainage", ["gravity drainage"]), ("wastewater conveyance", ["wastewater", "soil discharge"]), ("reduce_pressure", ["pressure reducing", "reduce pressure"]), ("fastening", [("hexagonal", "bolt")]),
]
INSTALLATION = [("building drainage", ["building"]), ("internal", ["internal"]), ("external", ["external"]), ("underground", ["underground"])]
COMPONENTS = ["fittings", "bends", "tees", "couplers", "clamps", "supports"]
REQUIREMENTS = ["watertight", "smooth internal surfaces", "resistant to normal domestic wastewater", "moisture", "corrosion", "leakage", "satisfactory flow"]
EXCLUDED = r"\b(?:not|excluding|except|without)\s+([a-z0-9\-/ ]{1,40})"
DIAMETERS = [r"(?i)\b(\d+(?:\.\d+)?)\s*mm\s+(?:nominal\s+)?diameter\b", r"(?i)\bdiameter\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*mm\b"]
NEEDS_FUNCTION, CONFIDENCE = ("valve", "cement"), 0.72
NOISE_LEFT, SNIPPET = 320, 240


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def _found(low: Column, cue: str) -> Column:
    return F.rlike(low, F.lit(cue)) if "\\" in cue or "(" in cue else F.contains(low, F.lit(cue))


def _told(low: Column, table: list) -> Column:
    """Values of the table whose cues a text holds, in table order."""
    hit = lambda cues: _any([_all([_found(low, c) for c in (cue if isinstance(cue, tuple) else (cue,))]) for cue in cues])
    return F.array_compact(F.array(*(F.when(hit(cues), F.lit(value)) for value, cues in table)))


def product(text: Column) -> Column:
    """The first product whose cues stand in the text, else its first word that is not a tender's."""
    low = F.lower(text)
    named = F
    for value, alternatives in PRODUCTS:
        named = named.when(_any([_all([_found(low, c) for c in cues]) for cues in alternatives]), F.lit(value))
    tokens = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0)), lambda w: ~F.lower(w).isin(*NO_PRODUCT))
    return named.otherwise(F.coalesce(F.get(tokens, F.lit(0)), F.lit("procurement item")))


def applications(text: Column) -> Column:
    low = F.lower(text)
    told = _told(low, APPLICATIONS)
    told = F.when(_any([F.contains(low, F.lit(p)) for p in NOT_ROOFING]), F.array_remove(told, "roofing")).otherwise(told)
    drains = F.exists(told, lambda x: F.contains(x, F.lit("drainage")))
    return F.when(F.contains(low, F.lit("building")) & drains, F.concat(told, F.array(F.lit("building drainage")))).otherwise(told)


def exclusions(text: Column) -> Column:
    """Phrases after a word that excludes them."""
    phrases = F.transform(F.regexp_extract_all(F.lower(text), F.lit(EXCLUDED), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(phrases, lambda x: x != ""))


def diameter(text: Column) -> Column:
    """Millimetres, from the first pattern that matches."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in DIAMETERS)).cast("double")


def plain_number(value: Column) -> Column:
    """110.0 -> 110, 12.50 -> 12.5 (to six decimals)."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(26,6)").cast("string"), r"0+$", ""), r"\.$", "")


def description(text: Column, product: Column, material: Column, application: Column, function: Column, installation: Column, diameter: Column) -> Column:
    """What is told of an item, each once; without application and function also the text, but for a contract's phrases."""
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.expr("cast(array() as array<string>)"))
    rest = F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, NOISE, " "), r"\s+", " ")), 1, NOISE_LEFT)
    bare = (F.size(application) == 0) & (F.size(function) == 0)
    size = F.when(diameter != 0, F.concat(plain_number(diameter), F.lit(" mm nominal diameter")))
    parts = F.concat(one(product), material, application, function, one(F.array_join(installation, " ")), one(size), one(F.when(bare, rest)))
    keys = F.transform(parts, lambda x: F.lower(x))
    return F.array_join(F.filter(parts, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), ", ")


def snippet(text: Column, value: Column) -> Column:
    """The first sentence that holds a word of the value of more than two letters, 240 characters; null if none does."""
    tokens = F.filter(F.split(F.lower(value), r"[_\s]+"), lambda w: F.char_length(w) > 2)
    has = lambda s: F.exists(tokens, lambda w: F.contains(F.lower(s), w))
    return F.substring(F.trim(F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), has), F.lit(0))), 1, SNIPPET)


def _evidence(field: str, values: Column) -> Column:
    """field, value, evidence, inferred of each value; what no sentence says is inferred from the value itself."""
    text = F.col("text")

    def told(v: Column) -> Column:
        found = snippet(text, v)
        return F.struct(F.lit(field).alias("field"), v.alias("value"), F.coalesce(found, F.translate(v, "_", " ")).alias("evidence"), found.isNull().alias("inferred"))

    return F.transform(values, told)


def extract(items: DataFrame) -> DataFrame:
    """Items (text, and any other columns but those added) with their attributes; rows without text go.

    An item without a number in its text has the one of its column `item`, if there.
    """
    c = F.col
    place = c("item").cast("string") if "item" in items.columns else F.lit(None).cast("string")
    told = items.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    low = F.lower("text")
    listed = lambda words: _told(low, [(w, [w]) for w in words])
    number = F.regexp_extract("text", r"(?i)\bItem\s+(?:No\.?\s*)?([A-Za-z0-9()./-]+)", 1)
    told = told.withColumns(
        {
            "item_no": F.coalesce(F.nullif(F.regexp_replace(number, r"^[ .:\-—]+|[ .:\-—]+$", ""), F.lit("")), place), "product": product(c("text")), "material": _told(F.concat(F.lit(" "), low, F.lit(" ")), MATERIALS),
            "application": applications(c("text")), "function": _told(low, FUNCTIONS), "installation": _told(low, INSTALLATION), "components": listed(COMPONENTS),
            "excluded": exclusions(c("text")), "diameter_mm": diameter(c("text")), "requirements": listed(REQUIREMENTS),
        }
    )
    size = F.when(c("diameter_mm").isNotNull(), F.array(F.concat(plain_number(c("diameter_mm")), F.lit(" mm")))).otherwise(F.expr("cast(array() as array<string>)"))
    evidence = F.concat(_evidence("material", c("material")), _evidence("application", c("application")), _evidence("function", c("function")), _evidence("installation_context", c("installation")), _evidence("dimensions.diameter", size))
    unclear = F.lower("product").isin(*NEEDS_FUNCTION) & (F.size("function") == 0) & (F.size("application") == 0)
    return told.withColumns(
        {
            "description": description(c("text"), c("product"), c("material"), c("application"), c("function"), c("installation"), c("diameter_mm")), "evidence": evidence, "ambiguity": unclear,
            "missing": F.when(unclear, F.array(F.lit("product subtype/function"))).otherwise(F.expr("cast(array() as array<string>)")), "confidence": F.lit(CONFIDENCE),
        }
    )
