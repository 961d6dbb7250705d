"""Registered queries over the given tables."""

from scenelake.plans import (  # noqa: F401
    browse_queries,
    change_queries,
    count_queries,
    expression_queries,
    file_queries,
    scene_queries,
    search_queries,
    upkeep_queries,
)
from scenelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
