"""One query text for two engines: macros that Spark and the oracle's engine spell differently.

The text avoids backslashes, so that string literals mean the same to both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# macro: (Spark, oracle); {0}, {1} are the arguments, which "|" parts
MACROS = {
    "unnest": ("explode({0})", "unnest({0})"),
    "size": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "len": ("CAST(char_length({0}) AS BIGINT)", "CAST(length({0}) AS BIGINT)"),
    "join": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "sort": ("array_sort({0})", "list_sort({0})"),
    "list": ("collect_list({0})", "list({0})"),
    "set": ("array_sort(collect_set({0}))", "list_sort(list_distinct(list({0})))"),
    "distinct": ("array_distinct({0})", "list_distinct({0})"),
    "inter": ("array_intersect({0}, {1})", "list_intersect({0}, {1})"),
    "has": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "pct": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "tok": ("regexp_extract_all(lower({0}), '[a-z0-9]+', 0)", "regexp_extract_all(lower({0}), '[a-z0-9]+')"),
    "all": ("regexp_extract_all({0}, {1}, {2})", "regexp_extract_all({0}, {1}, {2})"),
    "rlike": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "gsub": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "split": ("split({0}, {1})", "string_split_regex({0}, {1})"),
    "slice": ("slice({0}, {1}, {2})", "list_slice({0}, {1}, {1} + {2} - 1)"),
    "at": ("try_element_at({0}, {1})", "list_extract({0}, {1})"),
    "rank": ("CAST(row_number() OVER ({0}) AS BIGINT)", "row_number() OVER ({0})"),
    "sum": ("CAST(sum({0}) AS BIGINT)", "CAST(sum({0}) AS BIGINT)"),
    "md5": ("md5({0})", "md5({0})"),
    "if": ("CAST(count_if({0}) AS BIGINT)", "CAST(count_if({0}) AS BIGINT)"),
    "first": ("min_by({0}, {1})", "arg_min({0}, {1})"),
    "best": ("max_by({0}, {1})", "arg_max({0}, {1})"),
    "empty": ("CAST(array() AS ARRAY<STRING>)", "CAST([] AS VARCHAR[])"),
    "arr": ("array({0})", "[{0}]"),
    "compact": ("filter(array({0}), x -> x IS NOT NULL)", "list_filter([{0}], lambda x: x IS NOT NULL)"),
    "filter": ("filter({0}, x -> {1})", "list_filter({0}, lambda x: {1})"),
    "map": ("transform({0}, x -> {1})", "list_transform({0}, lambda x: {1})"),
    "range": ("sequence({0}, {1})", "generate_series({0}, {1})"),
    "bround": ("CAST(bround({0}) AS BIGINT)", "CAST(round_even({0}, 0) AS BIGINT)"),
    "str": ("CAST({0} AS STRING)", "CAST({0} AS VARCHAR)"),
    "within": ("instr({0}, {1})", "instr({0}, {1})"),
}
_SPLIT = re.compile(r"\|(?=(?:[^']*'[^']*')*[^']*$)")  # not inside quotes
_CALL = re.compile(r"@(\w+)\{([^{}]*)\}")


def render(text: str, oracle: bool) -> str:
    """Macros are written @name{a|b}; inner ones first."""
    while True:
        new = _CALL.sub(lambda m: MACROS[m[1]][oracle].format(*(x.strip() for x in _SPLIT.split(m[2]))), text)
        if new == text:
            return text
        text = new


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql_query(name: str, text: str, doc: str = "") -> None:
    """Registers text as a query and, for the other engine, as its oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(render(text, False))

    run.__doc__, run.__name__ = doc, name
    query(name, render(text, True))(run)
