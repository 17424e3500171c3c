"""Text keys as Column functions. They differ on purpose: each stage of the reference's pipeline compares texts by its own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of (Unicode) white space become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """Trimmed text, NULL if blank (F1)."""
    t = F.trim(c)
    return F.when(t != "", t)


def canonical_id(c: Column) -> Column:
    """Spaces, colons, PART n, SEC n, upper case."""
    t = F.regexp_replace(collapse(c), r"\s*:\s*", ":")
    t = F.regexp_replace(t, r"(?i)\bpart\s*(\d+)\b", "PART $1")
    return F.upper(F.regexp_replace(t, r"(?i)\bsec(?:tion)?\s*(\d+)\b", "SEC $1"))


def base_code(c: Column, pattern: str = r"\bIS(?:\s*/\s*IEC)?\s*\d{2,6}\b") -> Column:
    """The first code in an id, else the id."""
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")), c)


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_key(c: Column) -> Column:
    """Tokens joined by one space."""
    return F.array_join(tokens(c), " ")


def dash_key(c: Column) -> Column:
    """_ - / are spaces; other punctuation stays."""
    return collapse(F.translate(F.lower(c), "_-/", "   "))


def underscore_key(c: Column) -> Column:
    """_ is a space; the rest stays."""
    return collapse(F.translate(F.lower(c), "_", " "))


def query_key(c: Column) -> Column:
    """As the token key, after _ became a space."""
    return token_key(F.translate(c, "_", " "))


def leakage_key(c: Column) -> Column:
    """Lower case and single spaces alone."""
    return collapse(F.lower(c))


def audit_key(c: Column) -> Column:
    """Every other character is a space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def search_key(c: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return collapse(F.lower(c))


def compact_code(c: Column) -> Column:
    """Upper case without white space."""
    return F.regexp_replace(F.upper(c), r"(?U)\s+", "")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two token arrays, as sets; the value for two empty sets differs between callers."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def excerpt(c: Column, limit: int) -> Column:
    """Whole text up to limit characters, else limit - 3 of them, right-trimmed, and an ellipsis."""
    t = collapse(c)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def sentences(c: Column) -> Column:
    """Split after . ! or ? and white space."""
    return F.split(collapse(c), r"(?<=[.!?])\s+")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of normalised texts by padding."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
