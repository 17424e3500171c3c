"""Metadata of documents, derived from their texts with taxonomies that are tables.

Both taxonomies (aliases of products, patterns of attributes) are found in one pass over the texts by `phrases.annotate`; all that
follows is told row by row from the mentions, so that nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import phrases as P

BROADCAST_ROWS = 20_000
NON_PRODUCT = ["test_method", "code_of_practice", "terminology", "installation"]
# Cues of the kinds of documents, in order.
KIND_CUES = [
    ("test_method", ["method of test", "methods of test", "test method"]),
    ("code_of_practice", ["code of practice", "practice for"]),
    ("terminology", ["terminology", "glossary", "vocabulary"]),
    ("installation", ["installation", "laying", "fixing"]),
    ("material_standard", ["cement", "material", "steel", "timber"]),
    ("product_standard", ["requirements", "specification", "covers"]),
]
WEIGHTS = {"title": 3, "scope": 2, "summary": 2, "full_text": 1}


def kind(title: Column, scope: Column) -> Column:
    """The first kind of which title or scope holds a cue."""
    text, out = F.lower(F.concat_ws(" ", title, scope)), F
    for name, cues in KIND_CUES:
        test = F.contains(text, F.lit(cues[0]))
        for c in cues[1:]:
            test = test | F.contains(text, F.lit(c))
        out = out.when(test, name)
    return out.otherwise("other")


def phrase_hits(sources: DataFrame, phrases: DataFrame) -> DataFrame:
    """sources (with a column norm) x phrases of which the text holds the whole words. phrases: phrase and any other columns."""
    found = P.annotate(sources, phrases, ["norm"]).select(*sources.columns, F.explode("mentions").alias("m"))
    return found.select(*sources.columns, *(F.col("m")[c].alias(c) for c in phrases.columns))


def annotate(records: DataFrame, aliases: DataFrame, patterns: DataFrame | None = None, families: DataFrame | None = None) -> DataFrame:
    """records with mentions of both taxonomies, found in one pass, and without the full text."""
    named = aliases.select(F.lit("product").alias("field"), F.col("product").alias("value"), "phrase", "ord", F.lit(False).alias("headings_only"))
    named = named.withColumn("family", F.lit(None).cast("string")) if families is None else named.join(families.select(F.col("product").alias("value"), "family"), "value", "left").select(*named.columns, "family")
    if patterns is not None:
        named = named.unionByName(patterns.select("field", "value", "phrase", "ord", "headings_only").withColumn("family", F.lit(None).cast("string")))
    return P.annotate(records, named, list(WEIGHTS), drop=("full_text",))


def _scored() -> Column:
    """The products that mentions name, the best first: score, order of the source, ord, product, heading, evidence."""
    named = P.of_field("product")
    each = F.array_distinct(F.transform(named, lambda m: F.struct(m["ord"].alias("ord"), m["value"].alias("product"))))

    def score(p: Column) -> Column:
        own = F.filter(named, lambda m: (m["ord"] == p["ord"]) & (m["value"] == p["product"]))
        n = {s: F.size(F.filter(own, lambda m: m["source"] == F.lit(s))) for s in WEIGHTS}  # noqa: B023  called at once
        points = 3 * n["title"] + 2 * n["scope"] + 2 * n["summary"] + F.least(n["full_text"], F.lit(3))
        order = F.when(n["title"] > 0, 0).when(n["scope"] > 0, 1).when(n["summary"] > 0, 2).otherwise(3)
        evidence = F.filter(F.array(*(F.when(n[s] > 0, F.lit(s)) for s in ("title", "scope", "summary"))), lambda x: x.isNotNull())
        return F.struct((-points).alias("minus"), order.alias("order"), p["ord"].alias("ord"), p["product"].alias("product"), evidence.alias("evidence"))

    return F.array_sort(F.transform(each, score))


def with_products(annotated: DataFrame) -> DataFrame:
    """annotated with product, score, runner_up, confidence, evidence (where its aliases stand); null where none is named."""
    ranked = annotated.withColumn("_p", _scored())
    best, second = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    out = ranked.withColumn("product", best["product"]).withColumn("score", -best["minus"])
    out = out.withColumn("runner_up", F.when(F.col("product").isNotNull(), F.coalesce(-second["minus"], F.lit(0))))
    clear = F.col("score") >= F.col("runner_up") + 2
    heading = best["order"] < 2
    confidence = F.when(heading & clear, "high").when(F.array_contains(best["evidence"], "summary") & clear, "medium").otherwise("low")
    evidence = F.when(F.size(best["evidence"]) > 0, best["evidence"]).otherwise(F.array(F.lit("full_text_repeated_terms")))
    return out.withColumn("confidence", F.when(F.col("product").isNotNull(), confidence)).withColumn("evidence", F.when(F.col("product").isNotNull(), evidence)).drop("_p")


def products(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, product, score, runner_up, confidence, evidence of the records that name one. aliases: product, phrase, ord (of the product)."""
    return with_products(annotate(records.select("id", *WEIGHTS), aliases)).where("product is not null").select("id", "product", "score", "runner_up", "confidence", "evidence")


def attribute(field: str) -> Column:
    """The first value of the taxonomy that mentions tell; full texts do not count for values of headings."""
    own = F.filter("mentions", lambda m: (m["field"] == field) & (~m["headings_only"] | (m["source"] != "full_text")))
    return F.array_min(F.transform(own, lambda m: F.struct(m["ord"].alias("ord"), m["value"].alias("value"))))["value"]


def fallback_product(title: Column, stop: list[str]) -> Column:
    """The last four words or fewer that are neither stop words nor numbers, joined by _."""
    words = F.filter(T.tokens(title), lambda x: ~x.isin(*stop) & ~F.rlike(x, F.lit("^[0-9]+$")))
    last = F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), 4)
    return F.nullif(F.substring(F.array_join(last, "_"), 1, 128), F.lit(""))


def derive(records: DataFrame, aliases: DataFrame, families: DataFrame, patterns: DataFrame, stop: list[str]) -> DataFrame:
    """The metadata of each record (id, title, scope, summary, full_text), row by row: one pass over the texts, no shuffle.

    Documents that are no products (methods of test, codes of practice, ...) lose their product and keep its family as one
    they apply to. families: product, family. patterns: field, value, phrase, ord, headings_only (the full text does not count).
    """
    fields = [r.field for r in patterns.select("field").distinct().orderBy("field").collect()]  # a taxonomy's fields
    none = F.array().cast("array<string>")
    found = with_products(annotate(records.select("id", *WEIGHTS), aliases, patterns, families))
    in_headings = F.filter(P.of_field("product"), lambda m: m["source"] != "full_text")
    linked = F.array_sort(F.array_distinct(F.filter(F.transform(in_headings, lambda m: m["family"]), lambda x: x.isNotNull())))
    found = found.select("*", *(attribute(f).alias(f) for f in fields), linked.alias("applies_to"), (F.size(in_headings) > 0).alias("_in_heading")).drop("mentions", "score", "runner_up")
    heading = F.coalesce("summary", "title")
    base = found.withColumn("standard_kind", kind(heading, F.col("scope")))
    product = ~F.col("standard_kind").isin(*NON_PRODUCT)
    base = base.withColumn("_fallback", F.when(F.col("product").isNull() & product, fallback_product(heading, stop)))
    base = base.withColumn("confidence", F.when(F.col("_fallback").isNotNull(), F.when(F.coalesce(F.trim("scope"), F.lit("")) != "", "medium").otherwise("low")).otherwise(F.coalesce("confidence", F.lit("low"))))
    few = families.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    base = base.withColumn("product", F.coalesce("product", "_fallback")).join(F.broadcast(families) if few else families, "product", "left")
    demoted = F.col("family").isNotNull() & ~product
    base = base.withColumn("_demoted", demoted)
    base = base.withColumn("applies_to", F.when(F.col("_demoted"), F.array_sort(F.array_union("applies_to", F.array("family")))).otherwise(F.coalesce("applies_to", none)))
    base = base.withColumn("confidence", F.when(F.col("_demoted"), F.when(F.col("_in_heading"), "high").otherwise("medium")).otherwise(F.col("confidence")))
    for c in ("product", "family"):
        base = base.withColumn(c, F.when(~F.col("_demoted"), F.col(c)))
    review = F.when((F.col("confidence") == "low") & ~F.col("standard_kind").isin(*NON_PRODUCT), "low_confidence").when(F.col("_fallback").isNotNull() & (F.col("confidence") != "high"), "fallback_product")
    return base.withColumn("review_reason", review).withColumn("review_required", review.isNotNull()).drop("_fallback", "_demoted", "_in_heading", "title", "scope", "summary")
