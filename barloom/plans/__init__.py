"""Derived tables, and one registered query per operator."""

from importlib import import_module

MODULES = ["lake_queries", "quality_queries", "identity_queries", "action_queries", "feature_queries", "screen_queries", "outcome_queries", "evaluation_queries", "ledger_queries", "view_queries", "file_queries"]


def all_queries():
    for m in MODULES:
        import_module(f"barloom.plans.{m}")
    from barloom.plans.registry import QUERIES
    return QUERIES
