"""Filter predicates as Columns: between, equals, contains, gt, lt, gte, lte.

Predicates follow SQL three-valued logic: a NULL operand makes the predicate
NULL, and ``DataFrame.where`` keeps only rows where the combined condition is
TRUE. All of them are plain Catalyst expressions, so comparisons against
literals are pushed into the Parquet scan.
"""

from __future__ import annotations

import functools
import operator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import ColumnOrName, _col

# Operator names and combine modes accepted by a condition list.
OPERATORS = ("between", "equals", "contains", "gt", "lt", "gte", "lte")
DEFAULT_OPERATOR = "equals"
COMBINE_MODES = ("AND", "OR")


def like_escape(text: str) -> str:
    """Make a backslash literal in a LIKE pattern; ``%`` and ``_`` stay wildcards."""
    return text.replace("\\", "\\\\")


def between(c: ColumnOrName, low: Any, high: Any) -> Column:
    """Inclusive range ``low <= c <= high``."""
    return _col(c).between(F.lit(low), F.lit(high))


def equals(c: ColumnOrName, value: Any) -> Column:
    return _col(c) == F.lit(value)


def contains(c: ColumnOrName, value: str) -> Column:
    """Case-sensitive ``LIKE '%value%'``."""
    return _col(c).like(f"%{like_escape(str(value))}%")


def gt(c: ColumnOrName, value: Any) -> Column:
    return _col(c) > F.lit(value)


def lt(c: ColumnOrName, value: Any) -> Column:
    return _col(c) < F.lit(value)


def gte(c: ColumnOrName, value: Any) -> Column:
    return _col(c) >= F.lit(value)


def lte(c: ColumnOrName, value: Any) -> Column:
    return _col(c) <= F.lit(value)


_BUILDERS = {
    "equals": equals,
    "contains": contains,
    "gt": gt,
    "lt": lt,
    "gte": gte,
    "lte": lte,
}


def condition(column: str, operator_name: str | None = None, value: Any = None) -> Column:
    """One condition ``{column, operator, value}`` -> Column.

    ``between`` takes a pair ``[low, high]``. A missing operator means equals.
    An unknown operator raises ``ValueError``.
    """
    op = operator_name or DEFAULT_OPERATOR
    if op == "between":
        low, high = value
        return between(column, low, high)
    if op not in _BUILDERS:
        raise ValueError(f"unknown filter operator {op!r}; expected one of {OPERATORS}")
    return _BUILDERS[op](column, value)


def combine(predicates: list[Column], mode: str = "OR") -> Column:
    """Join predicates with one flat AND or OR."""
    mode = mode.upper()
    if mode not in COMBINE_MODES:
        raise ValueError(f"combine mode must be AND or OR, got {mode!r}")
    if not predicates:
        raise ValueError("no predicates to combine")
    return functools.reduce(operator.and_ if mode == "AND" else operator.or_, predicates)
