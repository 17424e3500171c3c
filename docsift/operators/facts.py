"""Facts with their places in a text, which SQL's regular expressions do not tell: an Arrow UDF over whole texts."""

from __future__ import annotations

import re
from difflib import get_close_matches

from pyspark.sql import Column
from pyspark.sql import functions as F

FACT = "array<struct<kind: string, value: string, begin: int, end: int, evidence: string>>"
# What a fact looks like, and the words near it that make it something else.
SIZE = re.compile(r"\b(\d+(?:\.\d+)?)\s*(?:[x×]\s*(\d+(?:\.\d+)?)\s*)?(?:[x×]\s*(\d+(?:\.\d+)?)\s*)?(mm|cm|m|inch)\b", re.I)
TEMPERATURE = re.compile(r"(-?\d+(?:\.\d+)?)\s*°?\s*C\b", re.I)
ADDRESS = re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")
NOT_A_SIZE = re.compile(r"tolerance|deviation|warpage|±|test", re.I)


def facts(text: str | None, window: int = 100, most: int = 240) -> list[dict]:
    """Sizes, temperatures and addresses; a size with tolerance or test words around it is none."""
    out = []
    for kind, pattern in (("size", SIZE), ("temperature", TEMPERATURE), ("address", ADDRESS)):
        for m in pattern.finditer(text or ""):
            around = text[max(0, m.start() - window) : m.end() + window]
            if kind == "size" and NOT_A_SIZE.search(around):
                continue
            value = " × ".join(x for x in m.groups()[:-1] if x) + f" {m.group(4).lower()}" if kind == "size" else f"{m.group(1)} C" if kind == "temperature" else m.group(0)
            out.append({"kind": kind, "value": value, "begin": m.start(), "end": m.end(), "evidence": " ".join(around.split())[:most]})
    return out


def extract_facts(text: Column) -> Column:
    return F.udf(facts, FACT, useArrow=True)(text)


def summary_heading(text: Column, marker: str = "SUMMARY OF", lines: int = 5, most: int = 500) -> Column:
    """The lines after a marker, up to a blank line, a numbered one or `lines`; spaces collapsed."""
    after = F.regexp_extract(text, rf"(?is){marker}\s*(.*)", 1)
    rows = F.slice(F.split(after, "\n"), 1, lines)
    state = F.aggregate(
        rows,
        F.struct(F.lit(False).alias("stop"), F.lit("").alias("out")),
        lambda s, x: F.when(s["stop"] | F.rlike(x, F.lit(r"^\s*(?:\d+[.)]|scope\b).*|^\s*$")) & (s["out"] != ""), F.struct(F.lit(True).alias("stop"), s["out"].alias("out"))).otherwise(
            F.struct(F.lit(False).alias("stop"), F.trim(F.concat_ws(" ", s["out"], F.trim(x))).alias("out"))
        ),
    )
    return F.nullif(F.substring(state["out"], 1, most), F.lit(""))


def scope_text(text: Column) -> Column:
    """The text after a scope heading up to the next numbered one, 20 to 1200 characters."""
    numbered = F.regexp_extract(text, r"(?is)\b1\.?\s*scope\s*[-—:.]*\s*(.{20,1200}?)(?=\n\s*2\.?\s|$)", 1)
    plain = F.regexp_extract(text, r"(?is)\bscope\s*[:—-]\s*(.{20,1200}?)(?=\n\n|$)", 1)
    return F.coalesce(F.nullif(F.trim(numbered), F.lit("")), F.nullif(F.trim(plain), F.lit("")))


def fuzzy_alias(value: Column, aliases: list[str], cutoff: float = 0.82) -> Column:
    """The alias nearest to a value by sequence ratio, if near enough."""

    @F.udf("string", useArrow=True)
    def nearest(x):
        found = get_close_matches(x, aliases, 1, cutoff) if x else []
        return found[0] if found else None

    return nearest(value)
