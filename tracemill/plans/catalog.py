"""All registered queries."""

from __future__ import annotations

from tracemill.plans import (  # noqa: F401
    case_queries,
    detection_queries,
    interval_queries,
    run_queries,
    signal_queries,
    source_queries,
    statistics_queries,
    streaming_queries,
    table_queries,
    tricorr_queries,
)
from tracemill.plans.registry import ORACLES, QUERIES
from tracemill.plans.signal_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
