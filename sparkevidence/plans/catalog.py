"""Imports every module of registered queries."""

from . import (  # noqa: F401
    q_chunks,
    q_evidence,
    q_lineage,
    q_metrics,
    q_quality,
    q_related,
    q_retrieval,
    q_rules,
    q_search,
    q_sources,
    q_structure,
)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
