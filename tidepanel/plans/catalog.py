"""Importing this module registers every query."""

from tidepanel.plans import audit_queries, decision_queries, evaluation_queries, model_queries, panel_queries  # noqa: F401
from tidepanel.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
