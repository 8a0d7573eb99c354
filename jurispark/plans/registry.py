"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jurispark.plans import api_queries, graph_queries, pipeline_queries, search_queries, structure_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

PARTS = (graph_queries, search_queries, pipeline_queries, text_queries, structure_queries, api_queries)
QUERIES: dict[str, Query] = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in PARTS for k, v in part.ORACLES.items()}
