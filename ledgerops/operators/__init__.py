"""DataFrame -> DataFrame operators: reconcile, aggregate, filter, analyze, clean, profile."""

from .aggregation import (
    AggregateResult,
    aggregate,
    aggregate_tables,
    check_same_columns,
    grand_total,
    group_columns,
    input_totals,
    top_groups,
    union_all,
    with_place,
)
from .analysis import Analysis, analyze, column_stats, safe_total
from .clean import ColumnSpec, clean_table, select_columns, transform_column
from .filters import FilterRange, filter_rows
from .profile import column_profile, detect_column, detect_roles, guess_type, key_candidates
from .reconciliation import ReconConfig, Reconciliation, Roles, clean_sources, reconcile, reconcile_sources, source_totals

__all__ = [
    "AggregateResult", "Analysis", "ColumnSpec", "FilterRange", "ReconConfig", "Reconciliation", "Roles",
    "aggregate", "aggregate_tables", "analyze", "check_same_columns", "clean_sources", "clean_table",
    "column_profile", "column_stats", "detect_column", "detect_roles", "filter_rows", "grand_total",
    "group_columns", "guess_type", "input_totals", "key_candidates", "reconcile", "reconcile_sources",
    "safe_total", "select_columns", "source_totals", "top_groups", "transform_column", "union_all", "with_place",
]
