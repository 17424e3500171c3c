"""Effective values: what a document's own words say overrides what was derived for it (D13); enums and functions of a requirement.

Ordered cascades as tables: a row holds a value and alternatives, each a tuple of cues that must all stand in the text; the
first row that holds decides. Null texts hold no cue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T

# Cues of a document's text in deciding order.
SUBTYPES = [
    ("pressure_reducing_valve", [("pressure reducing valve",)]), ("check_valve", [("reflux",), ("check valve",), ("non return",)]),
    ("portland_pozzolana_fly_ash", [("part 1 fly ash based",)]), ("portland_pozzolana_calcined_clay", [("part 2 calcined clay based",)]),
]
# Documents whose code alone tells the subtype.
CODES = {"portland_pozzolana_fly_ash": "IS 1489 (Part 1): 1991", "portland_pozzolana_calcined_clay": "IS 1489 (Part 2): 1991"}
MATERIALS = [
    ("GRP", [("glass fibre reinforced",), ("glass reinforced plastic",)]), ("HDPE", [("high density polyethylene",), ("hdpe",)]),
    ("UPVC", [("unplasticized polyvinyl chloride",), ("unplasticised polyvinyl chloride",)]), ("calcium silicate", [("calcium silicate",)]),
    ("fibrous", [("preformed fibrous",), ("fibrous pipe insulation",)]), ("clay", [("clay flooring",)]),
]
APPLICATIONS = [
    ("potable water supply", [("potable water",), ("drinking water",)]), ("industrial waste", [("industrial waste",), ("other than potable",), ("non potable",)]), ("sewerage", [("sewerage",), ("sewage",)]),
    ("flooring roofing", [("flooring", "roofing")]), ("flooring", [("flooring",)]), ("roofing", [("roofing",)]), ("thermal insulation", [("insulation",)]),
]
FORMS = [("preformed", [("preformed",), ("preormed",)])]
FAMILIES = {"pipe": "pipe_water_drainage", "valve": "water_valve"}
BY_SUBTYPE = {"pressure_reducing_valve": "reduce_pressure", "check_valve": "prevent_reverse_flow"}
BY_APPLICATION = {"potable water supply": "carry_potable_water", "sewerage": "carry_sewage", "industrial waste": "carry_sewage", "flooring": "flooring", "roofing": "roofing"}
SOURCES = {"portland_pozzolana_fly_ash": "fly_ash", "portland_pozzolana_calcined_clay": "calcined_clay"}
# What a requirement says of its function, cement, pozzolana, head and form, in deciding order.
WANTED = [
    (
        "prevent_reverse_flow",
        [("reverse flow",), ("non return",), ("non-return",), ("backflow",), ("flowing backwards",), ("flow backwards",), ("flow only one way",), ("only flow one way",), ("one way flow",), ("come back",)],
    ),
    ("reduce_pressure", [("reduce pressure",), ("pressure reducing",), ("pressure regulator",), ("pressure regulation",), ("downstream pressure control",), ("reduce downstream pressure",)]),
    ("release_air", [("release air",), ("air relief",)]),
]
CEMENTS = [("ppc", [("portland pozzolana",), ("ppc",), ("pozzolana",)]), ("opc", [("ordinary portland",), ("opc",)])]
POZZOLANAS = [("fly_ash", [("fly ash",), ("flyash",)]), ("calcined_clay", [("calcined clay",)])]
HEADS = [("hexagonal", [("hexagon",)])]
SHAPES = [("preformed", [("preformed",), ("pre formed",)])]

#: Fields and the columns that effective() adds for them, prefixed.
FIELDS = ("canonical_product", "family", "product_subtype", "subtype_family", "cement_type", "pozzolana_source", "material", "application", "function", "primary_subject", "form")


def cascade(text: Column, table: list, otherwise: Column | None = None) -> Column:
    """The value of the first row whose cues stand in the text."""
    holds = lambda cues: reduce(lambda x, y: x & y, (F.contains(text, F.lit(c)) for c in cues))
    out = F
    for value, alternatives in table:
        out = out.when(reduce(lambda x, y: x | y, map(holds, alternatives)), F.lit(value))
    return out.otherwise(F.lit(None).cast("string") if otherwise is None else otherwise)


def mapped(key: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """The value of a key, if the table has it."""
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(None).cast("string") if otherwise is None else otherwise)


def effective(docs: DataFrame, prefix: str = "effective_") -> DataFrame:
    """docs and the effective value of each of FIELDS. docs: standard_id, title, scope_text, retrieval_text and the stored
    canonical_product, family, product_subtype, material, application, function, primary_subject."""
    c, out = F.col, lambda name: F.col(prefix + name)
    text = T.underscore_key(F.concat_ws(" ", *(F.nullif(c(n), F.lit("")) for n in ("standard_id", "title", "scope_text", "retrieval_text", "primary_subject"))))
    has = lambda cue: F.contains(c("_text"), F.lit(cue))
    subtype = F
    for value, alternatives in SUBTYPES:
        told = reduce(lambda x, y: x | y, (has(cues[0]) for cues in alternatives))
        subtype = subtype.when(told | (c("standard_id").eqNullSafe(F.lit(CODES[value])) if value in CODES else F.lit(False)), F.lit(value))
    product = F.when(has("glass fibre reinforced") & has("pipe") & ~has("insulation"), "pipe").when(has("reflux") & has("valve"), "valve").otherwise(c("canonical_product"))
    first = docs.withColumn("_text", text).withColumns(
        {
            prefix + "canonical_product": product, prefix + "product_subtype": subtype.otherwise(c("product_subtype")), prefix + "material": cascade(c("_text"), MATERIALS, c("material")),
            prefix + "application": cascade(c("_text"), APPLICATIONS, c("application")), prefix + "form": cascade(c("_text"), FORMS),
        }
    )
    kind = F.coalesce(out("product_subtype"), F.lit(""))
    told = F.coalesce(mapped(out("product_subtype"), BY_SUBTYPE), mapped(out("application"), BY_APPLICATION), c("function"))
    return first.withColumns(
        {
            prefix + "family": mapped(out("canonical_product"), FAMILIES, c("family")), prefix + "subtype_family": F.when(kind == "check_valve", "check_valve"),
            prefix + "cement_type": F.when(F.contains(kind, F.lit("portland_pozzolana")), "ppc").when(F.contains(kind, F.lit("ordinary_portland")), "opc"),
            prefix + "pozzolana_source": mapped(out("product_subtype"), SOURCES), prefix + "function": told,
            prefix + "primary_subject": F.when(kind != "", F.translate(kind, "_", " ")).otherwise(c("primary_subject")),
        }
    ).drop("_text")


def description_function(text: Column) -> Column:
    """The function that a requirement's words ask for (Z3)."""
    return cascade(T.leakage_key(text), WANTED)


def _spoken(*parts: Column) -> Column:
    return T.dash_key(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def cement_type(value: Column, description: Column, subtype: Column) -> Column:
    return cascade(_spoken(value, description, subtype), CEMENTS)


def pozzolana_source(value: Column, description: Column, subtype: Column) -> Column:
    return cascade(_spoken(value, description, subtype), POZZOLANAS)


def head_shape(value: Column, description: Column) -> Column:
    return cascade(_spoken(value, description), HEADS, T.clean(value))


def form(value: Column, description: Column) -> Column:
    return cascade(_spoken(value, description), SHAPES, T.clean(value))


def subtype_family(value: Column, product: Column, aliases: list[str]) -> Column:
    """check_valve for valves of such a subtype, null for all else; aliases: what a check valve is called."""
    key = _spoken(value)
    hit = reduce(lambda x, y: x | y, (T.contains_phrase(key, F.lit(a)) for a in aliases)) | (key == "check valve")
    return F.when((product == "valve") & hit, "check_valve")
