"""The registered queries of the library's own operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .plans import control_queries, evidence_queries, label_queries, model_queries, place_queries, report_queries, resampling_queries, track_queries


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {name: Query(run, sql) for module in (evidence_queries, track_queries, resampling_queries, model_queries, report_queries, label_queries, control_queries, place_queries) for name, (run, sql) in module.QUERIES.items()}
FLAGSHIP = "model_evidence"
