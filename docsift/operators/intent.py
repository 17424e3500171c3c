"""Intents of requirements: grounded values, what is negated, what only surrounds, items of a text and templates of queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import phrases as P

# Words that negate what follows, and words before what only surrounds.
NEGATION = r"\b(?:not|no|except|excluding|without)\s+([a-z0-9\-/ ]{1,40})"
CONTEXT = r"\b(?:on|for|in|over|under|along)\s+(?:an?\s+|the\s+)?([a-z0-9\- ]{0,20}?)\s*\b(?:line|lines|pipeline|main|wall|floor|slab)\b"
GRADE = [r"\bgrade\s+([a-z0-9]+)\b", r"\b([0-9]{2,3})\s*grade\b", r"\bclass\s+([a-z0-9]+)\b"]
# Phrases of reverse flow after a negation, words that tell it, and words that ground a fastening.
REVERSE_FLOW = ["come back", "flow back", "flow backward", "flow backwards", "back flow", "backflow", "reverse flow"]
ONE_WAY = ["come backward", "flowing backwards", "flow backwards", "flow only one way", "flow one way", "only flow one way", "one way flow", "back flow", "backflow", "backward", "come back"]
FASTENING = ["fasten", "fastening", "anchor", "connect", "joint"]
CODE = r"\bIS(?:\s*/\s*IEC)?\s*:?\s*\d{2,6}(?:\s*\(part\s*\d+\))?(?:\s*:\s*\d{4})?"
_NEGATED, _CONTEXT = re.compile(NEGATION, re.ASCII), re.compile(CONTEXT, re.ASCII)


def negated(text: Column) -> Column:
    """Phrases that follow a negation, trimmed."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(NEGATION), F.lit(1)), lambda x: F.trim(x))


def surroundings(text: Column) -> Column:
    """What the product is used on or in."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(CONTEXT), F.lit(1)), lambda x: F.trim(x)))


def grade(text: Column) -> Column:
    """The first grade that a pattern finds, upper case (the word after `grade` goes first, as in the reference)."""
    found = [F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")) for p in GRADE]
    return F.upper(F.coalesce(*found))


def temperature(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), r"(-?\d+(?:\.\d+)?)\s*°?\s*c\b", 1), F.lit("")).cast("double")


def scrub(text: Column) -> Column:
    """The text without document codes."""
    return T.collapse(F.regexp_replace(text, rf"(?i){CODE}", " "))


def scopes(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and name of what negations and surroundings reach over; a negation of reverse flow has its own name."""
    out = []
    for m in _NEGATED.finditer(text):
        phrase = " ".join(re.split(r"[\s\-/]+", m[1]))
        out.append((*m.span(1), "reverse_flow" if any(c in phrase for c in REVERSE_FLOW) else "negation"))
    out += [(*m.span(1), "context") for m in _CONTEXT.finditer(text) if m[1]]
    return out


def _spaced(text: Column) -> Column:
    """White space and _ are spaces, one for one, so that offsets stay."""
    return F.regexp_replace(F.lower(text), r"[\s_]", " ")


def mentioned(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """queries with mentions of the vocabulary's values: offsets in the text, and a state: wanted, excluded or context.

    The scopes that hold a mention are found in one sweep. A negation reaches into surroundings within it; that water must not come
    back is what a check valve is for, so such a negation excludes nothing if the product (a column of queries, or named in the text)
    is a valve.
    """
    keyed = queries.withColumn("_spaced", _spaced(F.col("text")))
    found = P.annotate(keyed, vocabulary.select("field", "value", "phrase", "ord"), ["_spaced"], drop=("_spaced",), endings=("s", "ing"), breaks=True, scopes=scopes)
    named = F.exists("mentions", lambda m: (m["field"] == "product") & (m["value"] == "valve") & ~F.contains(m["scope"], F.lit("negation")))
    valve = F.coalesce(F.col("product") == "valve", F.lit(False)) if "product" in queries.columns else named
    found = found.withColumn("_valve", valve)
    excluded = lambda m: F.contains(m["scope"], F.lit("negation")) | (F.contains(m["scope"], F.lit("reverse_flow")) & ~F.col("_valve"))
    state = lambda m: F.when(excluded(m), "excluded").when(F.endswith(m["scope"], F.lit("context")), "context").otherwise("wanted")
    kept = ["field", "value", "ord", "begin", "end", "times"]
    return found.withColumn("mentions", F.transform("mentions", lambda m: F.struct(*(m[c].alias(c) for c in kept), state(m).alias("state"))))


def values(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, field, value, state, ord (the first): each value once a state in which a text names it."""
    m = mentioned(queries, vocabulary).select("query_id", F.explode("mentions").alias("m"))
    return m.groupBy("query_id", F.col("m.field").alias("field"), F.col("m.value").alias("value"), F.col("m.state").alias("state")).agg(F.min("m.ord").alias("ord"))


def _named(field: str, state: str) -> Column:
    """The values of a field in a state, in the vocabulary's order, each once."""
    own = F.filter("mentions", lambda m: (m["field"] == F.lit(field)) & (m["state"] == F.lit(state)))
    return F.array_distinct(F.transform(F.array_sort(F.transform(own, lambda m: F.struct(m["ord"].alias("ord"), m["value"].alias("value")))), lambda x: x["value"]))


def _holds(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for c in cues:
        out = out | F.contains(text, F.lit(c))
    return out


def intents(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row a query: q_<field>, q_excluded_<field> and context_<field> arrays in table order, q_grade, q_temperature_c, context_terms.

    What is excluded is not wanted, wherever else it stands. Functions are grounded: structural_fastening needs a cue in the text, and
    words of reverse flow tell prevent_reverse_flow. Of media, water is never excluded, and no potable means no potable water. Told
    row by row; a query without text has empty arrays.
    """
    fields = [r.field for r in vocabulary.select("field").distinct().orderBy("field").collect()]  # a vocabulary's fields
    out = mentioned(queries, vocabulary)
    key = T.dash_key(F.coalesce("text", F.lit("")))
    for f in fields:
        wanted, excluded = _named(f, "wanted"), _named(f, "excluded")
        if f == "function":
            wanted = F.filter(wanted, lambda x: (x != "structural_fastening") | _holds(key, FASTENING))
            wanted = F.when(_holds(key, ONE_WAY), F.array_union(wanted, F.array(F.lit("prevent_reverse_flow")))).otherwise(wanted)
        out = out.withColumn(f"q_{f}", F.array_except(wanted, excluded))
        if f == "medium":
            excluded = F.filter(excluded, lambda x: x != "water")
            excluded = F.array_distinct(F.transform(excluded, lambda x: F.when((x == "potable") & ~F.contains(key, F.lit("non potable")), "potable water").otherwise(x)))
        out = out.withColumn(f"q_excluded_{f}", excluded).withColumn(f"context_{f}", _named(f, "context"))
    around = F.filter(surroundings(F.coalesce("text", F.lit(""))), lambda x: x != "")
    return out.withColumn("q_grade", grade(F.col("text"))).withColumn("q_temperature_c", temperature(F.col("text"))).withColumn("context_terms", around).drop("mentions", "_valve")


def items(documents: DataFrame) -> DataFrame:
    """doc_id, item, text: items by their headers (Item 1: ...), else by numbered lines if there are two or more, else the whole."""
    t = F.coalesce("text", F.lit(""))
    headed = F.regexp_replace(t, r"(?im)(?:^|(?<=[.;\s]))(item\s*(?:no\.?\s*)?\d+\s*[:.)-])", "\u0001$1")
    numbered = F.regexp_replace(t, r"(?m)^(\s*\d+\s*[.)]\s+)", "\u0001$1")
    split = lambda c: F.filter(F.transform(F.split(c, "\u0001"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    parts = F.when(F.contains(headed, F.lit("\u0001")), split(headed)).when(F.size(split(numbered)) > 1, split(numbered)).otherwise(F.array(F.trim(t)))
    return documents.select("doc_id", F.posexplode(parts).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("item"), "text").where("text <> ''")


def templates(rows: DataFrame, candidates: list[Column], most: int = 12) -> DataFrame:
    """doc_id, position, query: the first `most` of the templates that are neither null nor name a code, each text once."""
    listed = F.filter(F.array(*candidates), lambda x: x.isNotNull() & (F.trim(x) != "") & ~F.rlike(x, F.lit(rf"(?i){CODE}")))
    long = rows.select("doc_id", F.posexplode(F.slice(F.array_distinct(F.transform(listed, T.collapse)), 1, most)).alias("position", "query"))
    first = Window.partitionBy(T.query_key(F.col("query"))).orderBy("doc_id", "position")
    return long.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
