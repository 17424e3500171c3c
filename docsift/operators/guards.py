"""What a service answers when something it asks is away: a default and a warning instead of an error (GR3, Z36)."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

A = TypeVar("A")
LOG = logging.getLogger("docsift")
#: What a store that is away raises.
AWAY = (OSError, ConnectionError, TimeoutError, PySparkException)


def degrade(ask: Callable[[], A], default: A, warning: str, away: tuple[type[Exception], ...] = AWAY) -> tuple[A, str | None]:
    """What is asked and no warning, or the default and the warning. Errors of any other kind are the caller's own and go through.

    Spark is lazy: ask must run what it returns (count, first, a write), or nothing can fail here.
    """
    try:
        return ask(), None
    except away as e:
        LOG.warning("%s: %s", warning, type(e).__name__)
        return default, warning


def count_or_null(spark: SparkSession, path: str) -> int | None:
    """Rows of a stored table; None if it is not there."""
    return degrade(lambda: spark.read.parquet(path).count(), None, "table may be missing")[0]


def neighbours_or_none(table: Callable[[], DataFrame], limit: int) -> tuple[list[dict], str | None]:
    """Up to limit neighbours of one document as rows, or none and a warning if the graph is away."""
    return degrade(lambda: [r.asDict() for r in table().limit(limit).collect()], [], "graph unavailable")
