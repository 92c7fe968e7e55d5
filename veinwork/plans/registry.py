"""All queries over the domain operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinwork.plans import directory_queries, incremental_queries, merge_queries, name_queries, postings_queries, profile_queries, relational_queries, request_queries, search_queries, sink_queries, source_queries, text_queries  # noqa: F401  they register
from veinwork.plans.base import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_end_to_end"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
