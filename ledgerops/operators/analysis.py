"""Statistics of a numeric column, safe totals, and the filter-then-analyze tool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import safe_double
from ..functions.names import column as col
from ..functions.names import resolve
from .aggregation import require_numeric
from .filters import FilterRange, filter_rows
from .totals import exact_totals, is_inexact


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: ``count`` (all rows, like COUNT(*)), ``total``, ``average``,
    ``minimum``, ``maximum`` of ``column``. Over no rows: count 0, the rest NULL.

    Only numeric columns are accepted (text would be summed after a silent cast).
    One pass with partial aggregation; the result is a single row. The total of
    doubles is exact and rounded once, the average is it over the number of values.
    """
    name = require_numeric(df, column)
    c = col(name)
    if is_inexact(df.schema[name].dataType) and not df.isStreaming:
        stats = exact_totals(df, [], {"total": c}, {"count": (F.lit(1), "count"), "values": (c, "count"),
                                                    "minimum": (c, "min"), "maximum": (c, "max")})
        average = F.when(F.col("values") > 0, F.col("total") / F.col("values"))
        return stats.select("count", "total", average.alias("average"), "minimum", "maximum")
    return df.agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(c).alias("total"),
        F.avg(c).alias("average"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
    )


def safe_total(df: DataFrame, columns: list[str]) -> DataFrame:
    """``SUM(TRY_CAST(col AS DOUBLE))`` per column in one row (text that does
    not parse counts as NULL), exact and rounded once. Output column per input: ``<col>_total``."""
    return exact_totals(df, [], {f"{c}_total": safe_double(col(c), df.schema[c].dataType) for c in columns})


@dataclass
class Analysis:
    filtered: DataFrame
    stats: DataFrame | None


def analyze(df: DataFrame, filters: list[dict | FilterRange], amount_col: str | None = None,
            combine_mode: str = "OR") -> Analysis:
    """Filter (AND/OR), then the five statistics of ``amount_col`` over the kept rows.

    ``stats`` is None when no amount column is chosen or it is not numeric.
    """
    filtered = filter_rows(df, filters, combine_mode)
    stats = None
    amount_col = resolve(df.columns, amount_col)
    if amount_col and isinstance(df.schema[amount_col].dataType, T.NumericType):
        stats = column_stats(filtered, amount_col)
    return Analysis(filtered=filtered, stats=stats)
