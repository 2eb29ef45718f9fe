"""All registered queries (importing the modules fills the registry)."""

from . import q_readings, q_sources, q_store, q_timeseries, q_twin, q_elements, q_tree, q_ops, q_audit, q_search, q_stream  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
