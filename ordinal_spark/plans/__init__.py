"""Pipelines (X1-X6) and the registered fixture queries."""

from . import q_analysis, q_extra, q_models, q_profile, q_reports  # noqa: F401  (register queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
