"""Inspection: row count, columns, schema information, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.names import column

# SQL names for Spark types, as spreadsheet-side SQL prints them.
_SQL_TYPE_NAMES = {
    T.LongType: "BIGINT",
    T.IntegerType: "INTEGER",
    T.ShortType: "SMALLINT",
    T.ByteType: "TINYINT",
    T.DoubleType: "DOUBLE",
    T.FloatType: "FLOAT",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.BinaryType: "BLOB",
}
DEFAULT_PREVIEW_ROWS = 1000


def sql_type_name(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    for cls, name in _SQL_TYPE_NAMES.items():
        if isinstance(data_type, cls):
            return name
    return data_type.simpleString().upper()


def row_count(df: DataFrame) -> int:
    """Number of rows (an action)."""
    return df.count()


def columns(df: DataFrame) -> list[str]:
    return list(df.columns)


def schema_info(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``(position, name, type, nullable)`` per column, as a small DataFrame."""
    rows = [(i, f.name, sql_type_name(f.dataType), bool(f.nullable)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def preview(df: DataFrame, n: int = DEFAULT_PREVIEW_ROWS, columns: list[str] | None = None,
            order_by: list[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows, optionally of chosen columns and in a given order.

    Unordered, Spark stops scanning once ``n`` rows are found; ordered, it
    keeps a top-``n`` heap per task (TakeOrderedAndProject), never a full sort.
    """
    out = df.select(*[column(c) for c in columns]) if columns else df
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(n)
