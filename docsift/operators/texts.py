"""Texts and flags of records: titles reconstructed, labelled retrieval texts, flags of quality, and products that name too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import text as T

# Words after which a title is cut off, and the labels of a retrieval text in order.
CUT_OFF = ("AND", "FOR", "OF", "TO", ",")
LABELS = ["STANDARD", "PRODUCT", "SUBTYPE", "SUBJECT", "FUNCTION", "MATERIAL", "APPLICATION", "TYPE", "TITLE", "SCOPE", "KEY SOURCE DESCRIPTION"]


def reconstructed_title(title: Column, summary: Column) -> Column:
    """The heading of the text, if it goes on where the title ends or the title is cut off; else null."""
    a, b = T.dash_key(F.coalesce(title, F.lit(""))), T.dash_key(F.coalesce(summary, F.lit("")))
    cut = F.lit(False)
    for end in CUT_OFF:
        cut = cut | F.endswith(F.rtrim(title, F.lit(" \t\n\r")), F.lit(end))
    longer = F.startswith(b, a) & (F.char_length(b) > F.char_length(a) + 2)
    return F.when((a != "") & (F.coalesce(summary, F.lit("")) != "") & (a != b) & (longer | cut), summary)


def retrieval_text(standard_code: Column, product: Column, subtype: Column, subject: Column, function: Column, material: Column, application: Column, kind: Column, title: Column, scope: Column, description: Column) -> Column:
    """Eleven labelled lines, those without a value left out; the kind is `other` if none is known."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    values = [*map(empty, (standard_code, product, subtype, subject, function, material, application)), F.coalesce(F.nullif(kind, F.lit("")), F.lit("other")), empty(title), T.collapse(empty(scope)), T.collapse(empty(description))]
    return F.concat_ws("\n", *(F.when(F.trim(v) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in zip(LABELS, values, strict=True)))


def quality_flags(title: Column, scope: Column, full_text: Column, confidence: Column, subject: Column, review: Column, sources: Column) -> Column:
    """Seven flags in order."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (blank(title), "missing_title"), (blank(scope), "missing_scope"), (blank(full_text), "missing_full_text"), (confidence == "low", "low_product_confidence"), (blank(subject), "missing_primary_subject"),
        (review, "metadata_review_required"), (F.coalesce(sources, F.lit(1)) > 1, "duplicate_source_records"),
    ]
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for holds, name in rules)))


def ambiguous(records: DataFrame, first: int = 8, most: int = 50) -> DataFrame:
    """key, query, plausible (sorted codes of the first few records), of keys that several records share, by key.

    records: place (their order), code, product, subtype, family, review. A limit before the shuffle keeps frequent keys small.
    """
    key = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("product", "subtype", "family")))
    named = records.where(~F.coalesce("review", F.lit(False))).select("place", "code", key.alias("key")).where("key is not null")
    place = F.row_number().over(Window.partitionBy("key").orderBy("place", "code"))
    some = named.withColumn("n", place).where(F.col("n") <= first).groupBy("key").agg(F.array_sort(F.collect_list("code")).alias("plausible"))
    said = F.concat(F.lit("Need "), F.translate("key", "_", " "), F.lit(" standard"))
    return some.where(F.size("plausible") > 1).select("key", said.alias("query"), "plausible").orderBy("key").limit(most)
