"""Imports every query module so that the registry is complete."""
from __future__ import annotations

from . import q_analytics, q_features, q_graph, q_io, q_lists, q_models, q_survival, q_warehouse  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
