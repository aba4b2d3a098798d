"""The resident-column store and the joins over it."""

from .joins import JOIN_KINDS, first_match_join, join_count, join_rows, join_sum, list_join
from .store import ResidentColumn, Store

__all__ = ["JOIN_KINDS", "ResidentColumn", "Store", "first_match_join", "join_count", "join_rows", "join_sum", "list_join"]
