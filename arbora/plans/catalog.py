"""All registered queries of the tree-data engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.plans import queries_awkward, queries_axes, queries_documents, queries_linked, queries_more, queries_navigation, queries_nested, queries_parts, queries_validation, queries_xpath, registry  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
