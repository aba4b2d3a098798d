"""Aggregates and window functions with the engine's rules for types, nulls, NaN and overflow."""

from .aggregates import agg_all, group_sum, hot_count, hot_max, hot_min, hot_sum, summary
from .windows import lag_lead, numbered, over, over_all, ranks, row_number, running, running_all, sliding

__all__ = [
    "agg_all", "group_sum", "hot_count", "hot_max", "hot_min", "hot_sum", "lag_lead", "numbered", "over", "over_all", "ranks", "row_number", "running",
    "running_all", "sliding", "summary",
]
