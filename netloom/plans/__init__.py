"""Registered queries."""


def all_queries():
    """Every registered query by name (importing the modules registers them)."""
    from netloom.plans import (  # noqa: F401
        dataset_queries, flow_queries, live_queries, document_queries, log_queries, score_queries)
    from netloom.plans.registry import QUERIES
    return QUERIES
