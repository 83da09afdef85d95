"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import curate_q, flow_q, io_q, metrics_q, more_q, p_core, refine_q, retrieve_q, score_q, text_q

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [p_core, metrics_q, curate_q, retrieve_q, text_q, flow_q, io_q, more_q, score_q, refine_q]

QUERIES: dict[str, Query] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
FLAGSHIP: Query = metrics_q.agg04_class_metrics
