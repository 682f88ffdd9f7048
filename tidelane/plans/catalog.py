"""The registered queries over the driver's tables, by importing every module that registers some."""

from . import event_queries, interval_queries, join_queries, matching_queries, result_queries, sequence_queries, signal_queries, sorting_queries, stat_queries, unit_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
