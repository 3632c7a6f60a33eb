"""Operator compositions and the catalogue of registered queries."""

from __future__ import annotations


def registered():
    """All (queries, check SQL), after importing every catalogue module."""
    from passagework.plans import catalog

    for name in MODULES:
        __import__(f"passagework.plans.{name}")
    return dict(catalog.QUERIES), dict(catalog.CHECKS)


MODULES = ["q_chunking", "q_ingest", "q_rules", "q_retrieval", "q_quality", "q_evaluation", "q_usage", "q_chatlog", "q_tenancy", "q_streaming"]
