"""Stack same-schema tables, group, count, sum, sort and total them.

``groupBy`` plans a partial (map-side) aggregation before the shuffle, so only
one row per group and map task crosses the network; a hot group costs one row
per task, not a third of the data. The grand total is computed from the
grouped rows in the same job instead of a second scan of the input.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column, resolve
from ..session import checkpoint_dir
from .totals import exact_totals, is_inexact

# Sort choices of the aggregate tool.
SORT_BY_TOTAL = "total"
SORT_BY_COUNT = "count"
SORT_BY_GROUP = "group"
SORT_CHOICES = (SORT_BY_TOTAL, SORT_BY_COUNT, SORT_BY_GROUP)


def check_same_columns(dfs: list[DataFrame], names: list[str] | None = None) -> None:
    """Column *name sets* must be equal to the first table's (order and types are free)."""
    if not dfs:
        raise ValueError("there is nothing to stack: no tables given")
    wanted = {c.lower() for c in dfs[0].columns}
    for i, df in enumerate(dfs[1:], start=1):
        have = {c.lower() for c in df.columns}
        if have != wanted:
            raise ValueError(f"{names[i] if names else f'table {i + 1}'} does not have the first table's columns: "
                             f"missing={sorted(wanted - have)}, extra={sorted(have - wanted)}")


def union_all(dfs: list[DataFrame], by: str = "name", validate: bool = True,
              names: list[str] | None = None) -> DataFrame:
    """UNION ALL of tables with the same columns; the first table fixes the order.

    ``by="name"`` aligns columns by name (safe when files list columns in a
    different order); ``by="position"`` stacks positionally like ``SELECT *``.
    Duplicates are kept. No job runs; the union is a narrow plan node.
    """
    if not dfs:
        raise ValueError("there is nothing to stack: no tables given")
    if validate and len(dfs) > 1:
        check_same_columns(dfs, names)
    if by == "name":
        order = [column(c) for c in dfs[0].columns]
        return functools.reduce(lambda x, y: x.unionByName(y.select(*order)), dfs[1:], dfs[0])
    if by == "position":
        return functools.reduce(DataFrame.union, dfs)
    raise ValueError("by must be 'name' or 'position'")


def group_columns(primary: str, extra: list[str] | None = None) -> list[str]:
    """Primary group column first, then the extra ones, duplicates removed in order."""
    return list(dict.fromkeys([primary, *(extra or [])]))


def require_numeric(df: DataFrame, name: str) -> str:
    """The table's own name of a numeric column; anything else is an error."""
    found = resolve(df.columns, name)
    if found is None:
        raise ValueError(f"column {name!r} not found: {df.columns}")
    dtype = df.schema[found].dataType
    if not isinstance(dtype, T.NumericType):
        raise TypeError(f"column {name!r} is {dtype.simpleString()}, not a number; "
                        "clean it first (clean_amount)")
    return found


def order_columns(sort_by: str | list[tuple[str, str]], group_cols: list[str]) -> list[Column]:
    """Sort spec -> ordering; NULLs last in both directions, group columns break ties."""
    if isinstance(sort_by, str):
        if sort_by == SORT_BY_TOTAL:
            spec = [("total_amount", "desc")]
        elif sort_by == SORT_BY_COUNT:
            spec = [("record_count", "desc")]
        elif sort_by == SORT_BY_GROUP:
            spec = [(group_cols[0], "asc")]
        else:
            raise ValueError(f"sort_by must be one of {SORT_CHOICES} or a list of (column, direction)")
    else:
        spec = list(sort_by)
    seen = {name for name, _ in spec}
    spec += [(g, "asc") for g in group_cols if g not in seen]
    out = []
    for name, direction in spec:
        if direction.lower() == "desc":
            out.append(column(name).desc_nulls_last())
        else:
            out.append(column(name).asc_nulls_last())
    return out


def aggregate(df: DataFrame, group_cols: list[str], sum_col: str,
              sort_by: str | list[tuple[str, str]] | None = SORT_BY_TOTAL) -> DataFrame:
    """GROUP BY ``group_cols``: ``record_count = COUNT(*)``, ``total_amount = SUM(sum_col)``.

    A NULL group key is its own group. Sums of doubles are exact and rounded once, so
    they don't depend on the order of rows or tasks (``totals``). ``sort_by=None`` leaves the result
    unsorted (saves the range-partition shuffle when order does not matter).
    """
    if not group_cols:
        raise ValueError("at least one group column is required")
    sum_col = require_numeric(df, sum_col)
    if is_inexact(df.schema[sum_col].dataType) and not df.isStreaming:
        grouped = exact_totals(df, group_cols, {"total_amount": column(sum_col)}, {"record_count": (F.lit(1), "count")})
    else:
        grouped = df.groupBy(*[column(g) for g in group_cols]).agg(
            F.count(F.lit(1)).alias("record_count"),
            F.sum(column(sum_col)).alias("total_amount"),
        )
    if sort_by is None:
        return grouped
    return grouped.orderBy(*order_columns(sort_by, group_cols))


def grand_total(grouped: DataFrame) -> DataFrame:
    """One row from an ``aggregate`` result: ``row_count`` (groups),
    ``total_records`` and ``grand_total``, without a second pass over the input. Totals that
    are doubles are added up exactly."""
    if is_inexact(grouped.schema["total_amount"].dataType) and not grouped.isStreaming:
        totals = exact_totals(grouped, [], {"grand_total": F.col("total_amount")},
                              {"row_count": (F.lit(1), "count"), "total_records": (F.col("record_count"), "sum")})
        return totals.withColumn("total_records", F.coalesce("total_records", F.lit(0)).cast("long"))
    return grouped.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("total_records"),
        F.sum("total_amount").alias("grand_total"),
    )


def input_totals(df: DataFrame, sum_col: str) -> DataFrame:
    """``COUNT(*)`` and ``SUM(sum_col)`` over the input rows themselves."""
    sum_col = require_numeric(df, sum_col)
    if is_inexact(df.schema[sum_col].dataType):
        return exact_totals(df, [], {"grand_total": column(sum_col)}, {"total_records": (F.lit(1), "count")})
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.sum(column(sum_col)).alias("grand_total"))


def with_place(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a sorted table numbered from 1 in their order, as the column ``name``.

    The sort's range partitions stay as they are: every row gets its partition and
    its number there in a checkpointed pass, rows per partition are counted, and
    the rows before each partition (one number per partition, on the driver) are
    added. No task sees more than its partition. Ties keep the order of the sort;
    an empty table stays empty."""
    checkpoint_dir(ordered.sparkSession)
    at = F.col("_row_at")
    rows = ordered.withColumn("_row_at", F.monotonically_increasing_id()).checkpoint()
    sizes = sorted(tuple(r) for r in rows.groupBy(F.shiftright(at, 33).alias("part")).count().collect())
    before = list(zip((part for part, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0)))
    starts = ordered.sparkSession.createDataFrame(before, "_part long, _before long")
    return (rows.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("_part"))
            .withColumn(name, (F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1))
            .drop("_row_at", "_part", "_before"))


def top_groups(grouped: DataFrame, k: int, sort_by: str | list[tuple[str, str]] = SORT_BY_TOTAL,
               group_cols: list[str] | None = None) -> DataFrame:
    """First ``k`` groups in sort order (planned as TakeOrderedAndProject: no full sort)."""
    if group_cols is None:
        group_cols = [c for c in grouped.columns if c not in ("record_count", "total_amount")]
    return grouped.orderBy(*order_columns(sort_by, group_cols)).limit(k)


@dataclass
class AggregateResult:
    combined: DataFrame
    groups: DataFrame
    totals: DataFrame


def aggregate_tables(dfs: list[DataFrame], primary: str, sum_col: str,
                     extra_groups: list[str] | None = None, sort_by: str = SORT_BY_TOTAL,
                     by: str = "name", names: list[str] | None = None,
                     materialize: bool = False) -> AggregateResult:
    """The aggregate tool: check and stack the tables, group, sort, total.

    Lazy by default. With ``materialize=True`` the grouped rows are computed
    once and checkpointed to the shared checkpoint folder (one pass over all
    inputs); the sorted groups and the totals are then read from it, so asking
    for both does not scan the inputs twice, and a lost executor does not
    send the job back to the inputs.
    """
    combined = union_all(dfs, by=by, names=names)
    cols = group_columns(primary, extra_groups)
    grouped = aggregate(combined, cols, sum_col, sort_by=None)
    if materialize:
        checkpoint_dir(grouped.sparkSession)
        grouped = grouped.checkpoint(eager=True)
    groups = grouped.orderBy(*order_columns(sort_by, cols))
    return AggregateResult(combined=combined, groups=groups, totals=grand_total(grouped))
