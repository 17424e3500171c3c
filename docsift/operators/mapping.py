"""Rows of the store from records: the curated mapping, the whole corpus' mapping, previews, and small projections.

Each mapping is one projection over the records, so that a scan reads what it names and nothing is shuffled. Null lists count as
empty; a null text stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T

# Statuses and the note of records whose lifecycle nobody has looked up.
UNKNOWN, PARSED = "UNKNOWN", "SOURCE_PARSED"
NOTE = "Historical parsed summary corpus; current lifecycle/QCO status not inferred."
#: Lists of a curated record's search profile.
PROFILE = ("product_family", "applications", "materials")
#: What a whole-corpus row takes from its record as it is.
KEPT = (
    "standard_kind", "canonical_product", "product_subtype", "primary_subject", "product_aliases", "material", "application", "function", "applies_to_product_families", "product_confidence",
    "metadata_confidence", "metadata_evidence", "metadata_derivation_method", "review_required", "review_reason", "raw_title", "canonical_title_expanded", "title_evidence", "scope_reconstructed", "scope_source",
    "family", "source_provenance",
)
#: Metadata values that are keywords, in this order; then the two lists.
KEYWORDS = ("canonical_product", "product_subtype", "primary_subject", "material", "application", "function", "standard_kind", "family")
KEYWORD_LISTS = ("product_aliases", "applies_to_product_families")
#: What a whole-corpus row's search profile repeats.
PROFILED = (
    "canonical_product", "product_subtype", "primary_subject", "product_aliases", "product_confidence", "product_derivation_source", "material", "application", "function", "applies_to_product_families",
    "metadata_confidence", "metadata_evidence", "metadata_derivation_method", "review_required", "review_reason", "standard_kind", "family", "source_provenance", "quality_flags",
)


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.expr("cast(array() as array<string>)"))


def part_of(canonical: Column) -> Column:
    return _found(canonical, r"\(PART\s+([^)]+)\)")


def section_of(canonical: Column) -> Column:
    return _found(canonical, r"\bSEC\s+(\d+)\b")


def year_of(canonical: Column) -> Column:
    """The year at the end of a canonical id."""
    return _found(canonical, r":(\d{4})\s*$").cast("int")


def revision_year(revision: Column) -> Column:
    """The last word of four digits."""
    words = F.filter(F.split(F.translate(revision, ":", " "), r"\s+"), lambda w: F.rlike(w, F.lit(r"^\d{4}$")))
    return F.get(words, F.size(words) - 1).cast("int")


def curated(records: DataFrame, dataset: str, profile: tuple[str, ...] = PROFILE) -> DataFrame:
    """The 22 columns of a curated record (Z11). records: standard_code, record_id, title, source_scope, lifecycle_status,
    lifecycle_status_note, source_revision, source_page_start, source_page_end, retrieval_text, full_text, and the lists of the
    profile."""
    c, key = F.col, T.canonical_id(F.col("standard_code"))
    terms = F.filter(F.concat(*map(_list, profile)), lambda t: t.isNotNull() & (F.trim(t) != ""))
    return records.select(
        c("standard_code").alias("standard_id"), key.alias("canonical_id"), T.base_code(key).alias("base_code"), part_of(key).alias("part"), section_of(key).alias("section"), "title", c("source_scope").alias("scope_text"),
        year_of(key).alias("publication_year"), F.coalesce(F.nullif("lifecycle_status", F.lit("")), F.lit(UNKNOWN)).alias("status"), F.lit(0).alias("amendments_count"),
        F.array_sort(F.array_distinct(F.transform(terms, T.search_key))).alias("keywords"), F.lit(dataset).alias("source_dataset"), c("record_id").alias("source_record_id"), "source_revision",
        "source_page_start", "source_page_end", "lifecycle_status", "lifecycle_status_note", "retrieval_text", T.search_key(c("retrieval_text")).alias("normalized_retrieval_text"), "full_text",
        F.struct(*(_list(p).alias(p) for p in profile)).alias("search_profile"),
    )


def whole_corpus(records: DataFrame, dataset: str) -> DataFrame:
    """The columns of a parsed record (Z12): title falls back to the code, keywords are the values there are.

    records: standard_code, standard_code_norm, title, scope, revision, page_start, page_end, retrieval_text, full_text,
    quality_flags, product_derivation_source and the columns of KEPT.
    """
    c, nothing = F.col, lambda kind: F.lit(None).cast(kind)
    values = F.concat(F.array(*(c(k) for k in KEYWORDS)), *map(_list, KEYWORD_LISTS))
    full = lambda name: F.coalesce(F.nullif(c(name), F.lit("")), c("standard_code"))
    return records.select(
        c("standard_code").alias("standard_id"), c("standard_code_norm").alias("canonical_id"), "standard_code_norm", T.base_code(c("standard_code_norm")).alias("base_code"), nothing("string").alias("part"),
        nothing("string").alias("section"), full("title").alias("title"), c("scope").alias("scope_text"), "scope", nothing("string").alias("division"), revision_year(c("revision")).alias("publication_year"),
        F.lit(PARSED).alias("status"), F.lit(0).alias("amendments_count"), F.filter(values, lambda v: v.isNotNull() & (v != "")).alias("keywords"), F.lit(dataset).alias("source_dataset"),
        c("standard_code_norm").alias("source_record_id"), c("revision").alias("source_revision"), c("page_start").alias("source_page_start"), c("page_end").alias("source_page_end"), "page_start", "page_end",
        nothing("string").alias("lifecycle_status"), F.lit(NOTE).alias("lifecycle_status_note"), "retrieval_text", T.search_key(c("retrieval_text")).alias("normalized_retrieval_text"), "full_text", *KEPT,
        F.struct(*PROFILED).alias("search_profile"),
    )


def preview(records: DataFrame, profile: tuple[str, ...] = PROFILE) -> DataFrame:
    """standard_code, product, application, material: lists joined by commas."""
    code = F.regexp_replace(T.canonical_id(F.col("standard_code")), ":", ": ")
    return records.select(code.alias("standard_code"), *(F.array_join(_list(p), ", ").alias(name) for p, name in zip(profile, ("product", "application", "material"), strict=True)))


def has_changes(old: str, new: str, values: list[str]) -> Column:
    """Whether any of the values differs between two structs, nulls included."""
    return reduce(lambda x, y: x | y, (~F.col(f"{old}.{v}").eqNullSafe(F.col(f"{new}.{v}")) for v in values))


def scope_phrase(scope: Column) -> Column:
    """220 characters of a scope on one line, without the full stops at its end."""
    return F.rtrim(F.substring(F.regexp_replace(T.collapse(F.coalesce(scope, F.lit(""))), r"\.+$", ""), 1, 220))


def title_phrase(title: Column, code: Column) -> Column:
    """The first five words of the title, else of the code, lower case."""
    return F.array_join(F.slice(F.split(T.collapse(F.lower(F.coalesce(F.nullif(title, F.lit("")), code))), " "), 1, 5), " ")


def product_description(scope: Column, title: Column) -> Column:
    """The scope's phrase and the title in brackets."""
    t = T.collapse(F.lower(F.coalesce(title, F.lit(""))))
    return F.when(t != "", F.concat(scope_phrase(scope), F.lit(" ("), t, F.lit(")"))).otherwise(scope_phrase(scope))


# What names a head in a parameter, and where its layer's number stands.
HEADS = ("classifier", "score", "classification_head")
LAYER = r"(?:encoder\.layer|layers)\.(\d+)\."


def parameter_groups(parameters: DataFrame, name: str = "name") -> DataFrame:
    """Parameters with their group: head, final, fourth from last or earliest layer, in this order; others null."""
    layer = _found(F.col(name), LAYER).cast("int")
    ends = parameters.agg(F.min(layer).alias("first"), F.max(layer).alias("last")).first()
    is_head = reduce(lambda x, y: x | y, (F.contains(F.col(name), F.lit(h)) for h in HEADS))
    return parameters.withColumn(
        "group",
        F.when(is_head, "classification_or_scoring_head")
        .when(layer == F.lit(ends.last).cast("int"), "final_transformer_layer")
        .when(layer == F.lit(ends.last).cast("int") - 3, "fourth_from_last_transformer_layer")
        .when(layer == F.lit(ends.first).cast("int"), "early_frozen_transformer_layer"),
    )


def scored(rows: DataFrame, score: Column) -> DataFrame:
    """Rows with score as a double: of a list its first element; an empty list is an error."""
    kind = rows.select(score.alias("s")).schema["s"].dataType.typeName()
    value = F.when(F.size(score) == 0, F.raise_error(F.lit("score sequence must not be empty")).cast("double")).otherwise(F.get(score, F.lit(0)).cast("double")) if kind == "array" else score.cast("double")
    return rows.withColumn("score", value)


def by_group(rows: DataFrame, group: str, position: str) -> DataFrame:
    """The scores of each group in the order of its candidates, by key rather than by place in a batch."""
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, "score"))), lambda x: x["score"]).alias("scores"))
