"""Importing this module registers every query."""

from riskframe.plans import (  # noqa: F401
    column_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    report_queries,
    scan_queries,
    sequence_queries,
)
from riskframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
