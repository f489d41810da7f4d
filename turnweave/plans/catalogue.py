"""All queries of the core, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnweave.plans import corpus, files, folds, pipeline, scoring, token_streams, transcripts

_MODULES = (transcripts, token_streams, corpus, scoring, folds, pipeline, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.oracle_sql()
    return found
