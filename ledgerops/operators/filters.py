"""Filter a table by a flat list of conditions combined with AND or OR.

Conditions are plain Catalyst predicates, so Spark pushes the comparisons into
the Parquet scan (``PushedFilters``) and prunes row groups by their min/max
statistics; no row leaves the scan unless it can match.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.names import resolve
from ..functions.predicates import combine, condition

# Filter kinds of the analyze tool.
FILTER_TYPES = ("amount", "date", "text")


@dataclass(frozen=True)
class FilterRange:
    """A range or text filter: text -> contains, amount/date -> between.

    Amount bounds are parsed to float; date bounds stay text and are compared
    by Spark's implicit cast against the column's date or timestamp type.
    """

    filter_type: str
    column: str
    min_val: Any
    max_val: Any = None

    def to_condition(self) -> dict:
        if self.filter_type not in FILTER_TYPES:
            raise ValueError(f"filter_type must be one of {FILTER_TYPES}")
        if self.filter_type == "text":
            return {"column": self.column, "operator": "contains", "value": self.min_val}
        low, high = self.min_val, self.max_val
        if self.filter_type == "amount":
            low, high = float(low), float(high)
        return {"column": self.column, "operator": "between", "value": [low, high]}


def _check_types(df: DataFrame, cond: dict) -> None:
    column = resolve(df.columns, cond["column"])
    if column is None:
        raise ValueError(f"filter column {cond['column']!r} not found: {df.columns}")
    dtype = df.schema[column].dataType
    op = cond.get("operator") or "equals"
    value = cond.get("value")
    if op == "contains" and not isinstance(dtype, T.StringType):
        raise TypeError(f"'contains' needs a text column; {column!r} is {dtype.simpleString()}")
    bounds = value if op == "between" else [value]
    numeric_bound = any(isinstance(v, (int, float)) and not isinstance(v, bool) for v in bounds)
    if op != "contains" and isinstance(dtype, T.StringType) and numeric_bound:
        raise TypeError(f"column {column!r} is text but compared with a number; clean it first")


def predicate(df: DataFrame, conditions: list[dict], combine_mode: str = "OR") -> Column | None:
    """Conditions -> one Column (None when the list is empty)."""
    if not conditions:
        return None
    for cond in conditions:
        _check_types(df, cond)
    preds = [condition(resolve(df.columns, c["column"]), c.get("operator"), c.get("value")) for c in conditions]
    return combine(preds, combine_mode)


def filter_rows(df: DataFrame, conditions: list[dict | FilterRange],
                combine_mode: str = "OR") -> DataFrame:
    """Rows where the combined condition is TRUE; an empty list keeps every row."""
    conds = [c.to_condition() if isinstance(c, FilterRange) else c for c in conditions]
    pred = predicate(df, conds, combine_mode)
    return df if pred is None else df.where(pred)
