"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelake.jobs import catalogue_queries, cue_queries, further_queries, shot_queries, vector_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return cue_queries.QUERIES | shot_queries.QUERIES | vector_queries.QUERIES | catalogue_queries.QUERIES | further_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return cue_queries.SQL | shot_queries.SQL | vector_queries.SQL | catalogue_queries.SQL | further_queries.SQL
