"""Constraint scoring of candidates against a requirement's intent, as Column functions driven by tables.

An attribute is scored by the best state of its wanted values; what a requirement excludes counts against a candidate that has
it. Cue tables are read in order, the first cue that a text contains decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.text import underscore_key

# Scores of the states, and the order in which one state outdoes another.
STATES = {"EXACT_MATCH": 4.0, "STRONG_COMPATIBLE": 3.0, "PARTIAL_MATCH": 1.5, "UNKNOWN": 0.0, "CONTRADICTION": -8.0}
PRODUCT_STATES = {"EXACT_PRODUCT": 8.0, "APPLIES_TO_PRODUCT": 5.0, "ADJACENT_PRODUCT": 2.0, "SAME_FAMILY": 0.75, "UNKNOWN": 0.0, "CONTRADICTION": -10.0}

# Cues of materials in order, groups of materials, groups whose members go together.
MATERIAL_CUES = [
    ("calcium silicate", "calcium silicate"), ("mineral wool", "mineral wool"), ("rock wool", "rock wool"), ("slag wool", "slag wool"), ("glass wool", "glass wool"),
    ("grp", "GRP"), ("gfrp", "GRP"), ("glass fibre reinforced", "GRP"), ("glass fiber reinforced", "GRP"), ("glass reinforced plastic", "GRP"),
    ("fibrous", "fibrous"), ("fibre", "fibrous"), ("fiber", "fibrous"), ("upvc", "UPVC"), ("unplasticized polyvinyl chloride", "UPVC"),
    ("cpvc", "CPVC"), ("chlorinated polyvinyl chloride", "CPVC"), ("polyvinyl chloride", "PVC"), ("pvc", "PVC"), ("hdpe", "HDPE"), ("high density polyethylene", "HDPE"),
    ("ldpe", "LDPE"), ("low density polyethylene", "LDPE"), ("polyethylene", "polyethylene"), ("polypropylene", "polypropylene"), ("plastic", "plastic"), ("polyurethane", "polyurethane"),
    ("steel", "steel"), ("metal", "metal"), ("malleable cast iron", "malleable cast iron"), ("cast iron", "cast iron"), ("brass", "brass"), ("copper alloy", "copper alloy"),
    ("finishing cement", "finishing cement"), ("cement", "cement"), ("concrete", "concrete"), ("ferrocement", "ferrocement"), ("sandstone", "sandstone"), ("clay", "clay"),
]
MATERIAL_GROUPS = {
    "metal": ["metal", "steel", "cast iron", "malleable cast iron", "brass", "copper alloy", "aluminium"],
    "plastic": ["HDPE", "LDPE", "PVC", "UPVC", "CPVC", "polypropylene", "polyethylene", "plastic"],
    "composite": ["GRP"],
    "fibrous_insulation": ["fibrous", "mineral wool", "rock wool", "slag wool", "glass wool"],
    "cementitious": ["cement", "finishing cement", "concrete", "ferrocement"],
    "ceramic": ["clay", "sandstone"],
    "calcium_silicate": ["calcium silicate"],
    "polyurethane": ["polyurethane", "PUR"],
}
TOGETHER = ["metal", "plastic", "fibrous_insulation"]
# Wanted applications, the cues that go with them, and the state they make.
IMPLIED = [
    ("sewerage", ["sewage", "sewerage", "drainage"], "STRONG_COMPATIBLE"),
    ("industrial waste", ["industrial waste", "effluent", "other than potable"], "STRONG_COMPATIBLE"),
    ("potable water supply", ["potable water", "drinking water"], "STRONG_COMPATIBLE"),
    ("water pipeline", ["water", "pipeline", "water supply"], "PARTIAL_MATCH"),
]
# How a text tells a range of temperatures.
TOP = r"(?:up to|upto|not exceeding|maximum|max)\s+(\d+(?:\.\d+)?)\s*(?:degrees?)?\s*c"
SPAN = r"(\d+(?:\.\d+)?)\s*(?:to|-)\s*(\d+(?:\.\d+)?)\s*(?:degrees?)?\s*c"
CHECK_VALVE = ["check valve", "reflux", "non return", "non-return", "swing check", "prevent reverse flow"]


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each computed once: an expression that is written twice is also evaluated, and compiled, twice."""
    bound = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.transform(F.array(bound), lambda s: f(*(s[f"v{i}"] for i in range(len(values)))))[0]


def any_cue(text: Column, cues: list[str]) -> Column:
    return F.lit(False) if not cues else _any([F.contains(text, F.lit(c)) for c in cues])


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def lookup(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[value]


def _text_state(q: Column, c: Column) -> Column:
    """Of two keys."""
    state = F.when(q.isin("potable", "potable water", "potable water supply") & any_cue(c, ["other than potable", "non potable"]), "CONTRADICTION").when(F.contains(c, q) | F.contains(q, c), "EXACT_MATCH")
    for value, cues, found in IMPLIED:
        state = state.when((q == value) & any_cue(c, cues), found)
    return state.otherwise("UNKNOWN")


def _subtype_state(q: Column, c: Column) -> Column:
    check, wanted = any_cue(c, CHECK_VALVE), q.isin("prevent reverse flow", "check valve")
    found = F.when(F.contains(c, q) | F.contains(q, c), "EXACT_MATCH").when(wanted & check, "STRONG_COMPATIBLE").when(wanted & F.contains(c, F.lit("pressure reducing")), "CONTRADICTION")
    return found.when(F.contains(q, F.lit("pressure reducing")) & check, "CONTRADICTION").otherwise(_text_state(q, c))


def _pozzolana_state(q: Column, c: Column) -> Column:
    ash, clay = F.contains(c, F.lit("fly ash")), F.contains(c, F.lit("calcined clay"))
    found = F.when((q == "fly ash") & clay, "CONTRADICTION").when((q == "fly ash") & ash, "EXACT_MATCH")
    return found.when((q == "calcined clay") & clay, "EXACT_MATCH").when((q == "calcined clay") & ash, "CONTRADICTION").otherwise(_text_state(q, c))


def _material_state(query: Column, candidate: Column) -> Column:
    """Of what is told of two texts."""
    q, c, gq, gc = query["cue"], candidate["cue"], query["kin"], candidate["kin"]
    pair = lambda a, b: ((q == a) & (c == b)) | ((q == b) & (c == a))
    found = F.when((q == "") | (c == ""), "UNKNOWN").when(q == c, "EXACT_MATCH").when(pair("clay", "sandstone"), "CONTRADICTION").when(pair("plastic", "GRP"), "STRONG_COMPATIBLE")
    return found.when((gq == gc) & gq.isin(*TOGETHER), "STRONG_COMPATIBLE").when(gq != gc, "CONTRADICTION").otherwise(_text_state(query["key"], candidate["key"]))


def told(text: Column) -> Column:
    """What states need of a text, read once: its key, its material and the material's group."""
    kin = {m: g for g, ms in MATERIAL_GROUPS.items() for m in ms}
    cues = F.array(*(F.struct(F.lit(cue).alias("cue"), F.lit(value).alias("value")) for cue, value in MATERIAL_CUES))
    cue = lambda key: F.coalesce(F.get(F.filter(cues, lambda x: F.contains(key, x["cue"])), F.lit(0))["value"], F.lit(""))
    return let(lambda key: let(lambda k, m: F.struct(k.alias("key"), m.alias("cue"), lookup(m, kin).alias("kin")), key, cue(key)), underscore_key(text))


class State:
    """A state of two texts; `of` tells it from what is told of them."""

    def __init__(self, of: Callable[[Column, Column], Column], keys: bool = True):
        self.of = (lambda q, c: of(q["key"], c["key"])) if keys else of

    def __call__(self, query: Column, candidate: Column) -> Column:
        return let(self.of, told(query), told(candidate))


text_state = State(_text_state)
#: Subtypes and functions; a check valve and a pressure-reducing one exclude each other.
subtype_state = State(_subtype_state)
pozzolana_state = State(_pozzolana_state)
material_state = State(_material_state, keys=False)


def best_state(states: Column) -> Column:
    """The best state of an array of them."""
    best = F.array(*map(F.lit, STATES))
    return let(lambda found: F.coalesce(F.get(F.filter(best, lambda s: F.array_contains(found, s)), F.lit(0)), F.lit("UNKNOWN")), states)


def _named(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")


def wished(values: Column) -> Column:
    """What is told of each value that is wanted."""
    return F.transform(_named(values), told)


def told_if_any(text: Column) -> Column:
    """What is told of a candidate's text; its key is null if the text is blank."""
    return told(F.nullif(F.trim(text), F.lit("")))


def attribute(values: Column, text: Column, field: str, state: State) -> tuple[Column, Column]:
    """Score and flag of a wanted attribute; 0 and no flag if nothing is wanted."""
    return _scored(_wanted_state(wished(values), told_if_any(text), state), field)


def _wanted_state(wanted: Column, text: Column, state: State) -> Column:
    each = lambda ws, t: best_state(F.transform(ws, lambda w: state.of(w, t)))
    return let(lambda ws, t: F.when(F.size(ws) == 0, F.lit(None)).when(t["key"].isNull(), "UNKNOWN").otherwise(each(ws, t)), wanted, text)


def _scored(found: Column, field: str) -> tuple[Column, Column]:
    return F.coalesce(lookup(found, STATES), F.lit(0.0)), F.concat(F.lit(f"{field}_"), found)


def exclusion(values: Column, text: Column, field: str, state: State) -> tuple[Column, Column]:
    """-8 and a contradiction if the candidate has what is excluded; a candidate without text is clear."""
    return _excluded(_unwanted(wished(values), told_if_any(text), state), field)


def _unwanted(unwanted: Column, text: Column, state: State) -> Column:
    like = ["EXACT_MATCH", "STRONG_COMPATIBLE", "PARTIAL_MATCH"]
    hit = lambda ws, t: t["key"].isNotNull() & best_state(F.transform(ws, lambda w: state.of(w, t))).isin(*like)
    return let(lambda ws, t: F.when(F.size(ws) > 0, hit(ws, t)), unwanted, text)


def _excluded(found: Column, field: str) -> tuple[Column, Column]:
    return F.when(found, STATES["CONTRADICTION"]).otherwise(0.0), F.concat(F.lit(f"EXCLUDED_{field}_"), F.when(found, "CONTRADICTION").when(~found, "CLEAR"))


def temperature_ranges(text: Column) -> Column:
    """Ranges that a text tells: up to x, or x to y (the bare c at the end is the reference's)."""
    t = underscore_key(F.coalesce(text, F.lit("")))
    all_ = lambda p, i: F.regexp_extract_all(t, F.lit(p), F.lit(i))
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    tops = F.transform(all_(TOP, 1), lambda x: pair(F.lit(-273.15), x.cast("double")))
    spans = F.zip_with(all_(SPAN, 1), all_(SPAN, 2), lambda a, b: pair(F.least(a.cast("double"), b.cast("double")), F.greatest(a.cast("double"), b.cast("double"))))
    return F.concat(tops, spans)


def temperature(value: Column, text: Column) -> tuple[Column, Column]:
    return _temperature(value, temperature_ranges(text))


def _temperature(value: Column, ranges: Column) -> tuple[Column, Column]:
    state = F.when(F.size(ranges) == 0, "UNKNOWN").when(F.exists(ranges, lambda r: value.between(r["low"], r["high"])), "MATCH").otherwise("CONTRADICTION")
    score = lookup(state, {"UNKNOWN": "0", "MATCH": "4", "CONTRADICTION": "-8"}).cast("double")
    return F.when(value.isNull(), 0.0).otherwise(score), F.when(value.isNotNull(), F.concat(F.lit("TEMPERATURE_"), state))


def grade(value: Column, text: Column, known: tuple[str, ...] = ("33", "43", "53")) -> tuple[Column, Column]:
    return _grade(value, underscore_key(F.coalesce(text, F.lit(""))), known)


def _grade(value: Column, t: Column, known: tuple[str, ...] = ("33", "43", "53")) -> tuple[Column, Column]:
    g = F.lower(value)
    match = F.contains(t, F.concat(g, F.lit(" grade"))) | F.contains(t, F.concat(F.lit("grade "), g))
    other = _any([(g != k) & F.contains(t, F.lit(f"{k} grade")) for k in known])
    letter = F.rlike(g, F.lit("^[a-z]+$")) & F.contains(t, F.lit("grade "))
    state = F.when(match, "MATCH").when(other | letter, "CONTRADICTION").otherwise("UNKNOWN")
    score = lookup(state, {"UNKNOWN": "0", "MATCH": "4", "CONTRADICTION": "-8"}).cast("double")
    return F.when(value.isNull(), 0.0).otherwise(score), F.when(value.isNotNull(), F.concat(F.lit("GRADE_"), state))


def compatibility(query: Column, candidate: Column, query_family: Column, candidate_family: Column) -> Column:
    """The lattice of products; two products without a family are of one family (null-safe)."""
    adjacent = ((query == "pipe") & (candidate == "pipe_fitting")) | ((query == "pipe_fitting") & (candidate == "pipe"))
    state = F.when(query.isNull(), "unknown_query_product").when(candidate.isNull(), "unknown_candidate_product").when(query == candidate, "compatible").when(adjacent, "adjacent")
    return state.when(query_family.eqNullSafe(candidate_family), "same_family").otherwise("incompatible")


def product_state(query: Column, candidate: Column, query_family: Column, candidate_family: Column, applies_to: Column) -> Column:
    fit = compatibility(query, candidate, query_family, candidate_family)
    applies = F.coalesce(F.array_contains(applies_to, query_family), F.lit(False))
    state = F.when(query.isNull() | candidate.isNull(), "UNKNOWN").when(query == candidate, "EXACT_PRODUCT").when(applies, "APPLIES_TO_PRODUCT")
    return state.when(fit == "adjacent", "ADJACENT_PRODUCT").when(fit == "same_family", "SAME_FAMILY").otherwise("CONTRADICTION")


#: Attributes, the candidate columns that tell them, and how their states are found.
ATTRIBUTES = [
    ("material", ["material", "primary_subject", "product_subtype", "title", "scope"], material_state),
    ("function", ["function", "product_subtype", "title"], subtype_state),
    ("application", ["application", "scope", "title"], text_state),
    ("pozzolana_source", ["pozzolana_source", "product_subtype", "title", "scope"], pozzolana_state),
    ("subtype", ["product_subtype", "primary_subject", "title"], subtype_state),
    ("form", ["form", "primary_subject", "title", "scope"], text_state),
]
EXCLUDED = [("material", material_state), ("function", subtype_state), ("application", text_state), ("subtype", subtype_state), ("medium", text_state), ("installation", text_state)]


def _text(rows: DataFrame, names: list[str]) -> Column:
    return F.concat_ws(" ", *(F.col(n) for n in names if n in rows.columns))


def prepared(docs: DataFrame) -> DataFrame:
    """docs with what is told of their texts, for score: read once a document, before it meets many queries."""
    all_ = {name: told_if_any(_text(docs, columns)) for name, columns, _ in ATTRIBUTES}
    all_["whole"] = told_if_any(_text(docs, ["material", "function", "application", "product_subtype", "title", "scope"]))
    all_["grade"] = underscore_key(_text(docs, ["product_subtype", "title"]))
    all_["ranges"] = temperature_ranges(_text(docs, ["title", "scope", "retrieval_text"]))
    return docs.select("*", *(c.alias(f"told_{name}") for name, c in all_.items()))


def asked(queries: DataFrame) -> DataFrame:
    """queries (columns q_...) with what is told of their wishes, for score."""
    names = [name for name, _, _ in ATTRIBUTES] + [f"excluded_{name}" for name, _ in EXCLUDED]
    return queries.select("*", *(wished(F.col(f"q_{name}")).alias(f"wish_{name}") for name in names if f"q_{name}" in queries.columns))


def score(rows: DataFrame) -> DataFrame:
    """rows with constraint_score and flags.

    rows: candidate columns (product, family, applies_to, title, scope and any of ATTRIBUTES') and, with the prefix q_, the
    intent's (q_product, q_family, arrays q_material, ..., q_excluded_material, ..., q_grade, q_temperature_c). Columns that
    are not there count as null. If documents were prepared() and queries asked() before they met, texts are not read again.
    """
    own = [c for c in rows.columns if not c.startswith(("told_", "wish_"))]
    rows = rows if "told_whole" in rows.columns else prepared(rows)
    rows = rows if any(c.startswith("wish_") for c in rows.columns) else asked(rows)
    has = lambda c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    # States are columns of their own, so that score and flag do not tell them twice.
    states = {"state_product": product_state(has("q_product"), has("product"), has("q_family"), has("family"), has("applies_to", "array<string>"))}
    states |= {f"state_{name}": _wanted_state(F.col(f"wish_{name}"), F.col(f"told_{name}"), how) for name, _, how in ATTRIBUTES if f"wish_{name}" in rows.columns}
    states |= {f"state_not_{name}": _unwanted(F.col(f"wish_excluded_{name}"), F.col("told_whole"), how) for name, how in EXCLUDED if f"wish_excluded_{name}" in rows.columns}
    rows = rows.select("*", *(c.alias(name) for name, c in states.items()))
    parts = [(lookup(F.col("state_product"), PRODUCT_STATES), F.concat(F.lit("PRODUCT_"), "state_product"))]
    parts += [_scored(F.col(f"state_{name}"), name.upper()) for name, _, _ in ATTRIBUTES if f"state_{name}" in states]
    parts += [_excluded(F.col(f"state_not_{name}"), name.upper()) for name, _ in EXCLUDED if f"state_not_{name}" in states]
    if "q_grade" in rows.columns:
        parts.append(_grade(F.col("q_grade"), F.col("told_grade")))
    if "q_temperature_c" in rows.columns:
        parts.append(_temperature(F.col("q_temperature_c").cast("double"), F.col("told_ranges")))
    total = parts[0][0]
    for s, _ in parts[1:]:
        total = total + s
    return rows.select(*own, total.alias("constraint_score"), F.array_compact(F.array(*(f for _, f in parts))).alias("flags"))


def gate(rows: DataFrame, fit: Column) -> DataFrame:
    """gated_rank: candidates that fit, then unknown ones, then the others, each in their order (query_id, rank)."""
    bucket = F.when(fit.isin("compatible", "adjacent", "same_family"), 0).when(F.startswith(fit, F.lit("unknown")), 1).otherwise(2)
    return rows.withColumn("_bucket", bucket).withColumn("gated_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_bucket", "rank"))).drop("_bucket")


def order(rows: DataFrame) -> DataFrame:
    """constraint_rank by score, those below zero last of all."""
    w = Window.partitionBy("query_id").orderBy(F.least("constraint_score", F.lit(0.0)).desc(), F.desc("constraint_score"), "rank")
    return rows.withColumn("constraint_rank", F.row_number().over(w))


def final_order(rows: DataFrame, base: str = "rrf_score") -> DataFrame:
    """final_score = base + constraint_score, and final_rank; contradicted candidates come last."""
    rows = rows.withColumn("final_score", F.col(base) + F.col("constraint_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("constraint_score") < 0, F.desc("final_score"), "rank")
    return rows.withColumn("final_rank", F.row_number().over(w))
