"""Clean pipeline: per-column type rules, output formats and column selection.

The spec becomes projections in one stage, with no shuffle: every included
column is cleaned and excluded columns are dropped (Spark reads only the
included ones from the scan); columns with a date format are then parsed once
and formatted in projections of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.names import column, resolve

from ..functions.cleaning import (
    amount_parts,
    clean_amount,
    clean_boolean,
    clean_date,
    date_pattern,
    format_number,
    parse_amount,
    parse_date,
    plain_text,
    precision_of,
    to_text,
)

# User-facing types and their format menus.
DATA_TYPES = {
    "Text": (),
    "Number": ("0.00", "0", "0.000", "0.0000"),
    "Date": ("YYYY-MM-DD", "DD/MM/YYYY", "MM/DD/YYYY", "DD-MMM-YYYY"),
    "Boolean": (),
}


@dataclass(frozen=True)
class ColumnSpec:
    """How to treat one column: include it?, its type and an optional format."""

    name: str
    include: bool = True
    type: str = "Text"
    format: str | None = None


def column_expression(name: str, data_type: T.DataType, kind: str) -> Column:
    """The cleaning expression of one column, before any output format."""
    if kind == "Number":
        return clean_amount(name, data_type)
    if kind == "Date":
        return clean_date(name)
    if kind == "Boolean":
        return clean_boolean(name)
    if kind == "Text":
        return column(name)
    raise ValueError(f"unknown column type {kind!r}; expected one of {tuple(DATA_TYPES)}")


def formatted(df: DataFrame, formats: dict[str, tuple[str, str, T.DataType]]) -> DataFrame:
    """Output formats of already cleaned columns: name -> (kind, format, type of the source column).

    A date is parsed once, in a projection of its own, and then formatted: the
    parser names its text many times, and cleaning it at each place would repeat
    the whole cleaner."""
    parse = {n: parse_date(n, t) for n, (kind, _, t) in formats.items() if kind == "Date"}
    parsed = df.withColumns(parse) if parse else df
    out = {n: F.date_format(column(n), date_pattern(fmt)) if kind == "Date" else format_number(n, precision_of(fmt))
           for n, (kind, fmt, _) in formats.items()}
    return parsed.withColumns(out) if out else parsed


def transform_column(df: DataFrame, column: str, target_type: str) -> DataFrame:
    """Change one column in place: ``number``, ``date``, ``boolean`` or ``text``.

    An unknown target type leaves the table unchanged.
    """
    column = resolve(df.columns, column) or column
    dtype = df.schema[column].dataType
    kinds = {"number": "Number", "date": "Date", "boolean": "Boolean"}
    if target_type == "text":
        return columns_to_text(df, [column])
    if target_type not in kinds:
        return df
    return df.withColumn(column, column_expression(column, dtype, kinds[target_type]))


def columns_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as text, in place.

    A floating point value's text is bound to a lambda's variable, so that it is made
    once. Written out for several columns, the expression would make one compiled
    method too large for the JVM to optimise, which costs far more."""
    def text(name: str, kind: T.DataType) -> Column:
        if not isinstance(kind, (T.DoubleType, T.FloatType)):
            return to_text(name, kind)
        both = F.struct(column(name).alias("value"), column(name).cast("string").alias("text"))
        return F.get(F.transform(F.array(both), lambda x: plain_text(x["value"], x["text"])), F.lit(0))

    names = [resolve(df.columns, c) or c for c in columns]
    return df.withColumns({n: text(n, df.schema[n].dataType) for n in names}) if names else df


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the named columns in the given order."""
    found = [resolve(df.columns, c) for c in columns]
    missing = [c for c, f in zip(columns, found) if f is None]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[column(c) for c in found])


def dedupe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of each group equal in ``columns`` (all columns by default); NULL equals NULL.

    Which of the rows stays is not fixed when other columns differ. Copies are
    combined map-side, so a group of any size is one row per task in the shuffle."""
    if columns is None:
        return df.dropDuplicates()
    return df.dropDuplicates(select_columns(df, columns).columns)


# Names of the staged parts of an amount's text, behind the column's own name.
KEPT, SIGN = "\ue000kept", "\ue000sign"


def _amounts_staged(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """``df`` with the digits and signs of its text amounts in columns of their own: the parser names them many times."""
    names = {resolve(df.columns, s.name) for s in specs if s.type == "Number"} - {None}
    parts = {n: amount_parts(n) for n in names if isinstance(df.schema[n].dataType, T.StringType)}
    return df.withColumns({**{f"{n}{KEPT}": kept for n, (kept, _) in parts.items()},
                           **{f"{n}{SIGN}": sign for n, (_, sign) in parts.items()}}) if parts else df


def clean_table(df: DataFrame, specs: list[ColumnSpec | dict], on_error: str = "raise") -> DataFrame:
    """Apply the specs and keep the included columns in spec order.

    ``on_error="skip"`` leaves a column that cannot be cleaned as it is (the
    desktop behaviour); ``"raise"`` stops (the web behaviour). Errors are
    found while the plan is built, before any job runs.
    """
    specs = [s if isinstance(s, ColumnSpec) else ColumnSpec(**s) for s in specs]
    included = [s for s in specs if s.include]
    if not included:
        raise ValueError("at least one column must be included")
    cleaned, formats = [], {}
    df = _amounts_staged(df, included)
    for spec in included:
        name = resolve(df.columns, spec.name)
        if name is None:
            raise ValueError(f"column {spec.name!r} not found: {df.columns}")
        dtype = df.schema[name].dataType
        typed_date = spec.type == "Date" and spec.format and not isinstance(dtype, T.StringType)
        try:
            # a DATE or timestamp column that gets a format needs no text in between
            expr = column(name) if typed_date else column_expression(name, dtype, spec.type)
            if spec.type == "Number" and f"{name}{KEPT}" in df.columns:
                expr = parse_amount(column(f"{name}{KEPT}"), column(f"{name}{SIGN}"))
            wanted = (spec.type, spec.format, dtype) if spec.format and spec.type in ("Number", "Date") else None
            formatted(df.select(expr.alias(name)), {name: wanted} if wanted else {}).schema  # analysis errors surface here
        except (ValueError, TypeError, AnalysisException):
            if on_error == "raise":
                raise
            expr, wanted = column(name), None
        cleaned.append(expr.alias(name))
        if wanted:
            formats[name] = wanted
    return formatted(df.select(*cleaned), formats)
