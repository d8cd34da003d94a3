"""Structured Streaming: the same tools over files that keep arriving.

Ledger exports typically land as new files in a folder (one per month, per
bank, per day). The cleaners and filters are plain column expressions and the
totals are a grouped aggregation, so they run unchanged on a streaming
DataFrame: Spark keeps the running totals in its state store, processes only
new files per micro-batch and, with a checkpoint in the shared checkpoint
folder, resumes exactly where it stopped after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregation import aggregate
from ..operators.clean import ColumnSpec, clean_table
from ..operators.filters import FilterRange, filter_rows
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv",
                base_path: str | None = None, max_files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """Streaming read of a folder (or glob) of CSV or Parquet files.

    A schema is required: for CSV give every column as text and let the
    cleaners type it, exactly as in the batch tools.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("escape", '"')
    if base_path:
        reader = reader.option("basePath", base_path)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.options(**options).load(path)


def clean_stream(df: DataFrame, specs: list[ColumnSpec | dict]) -> DataFrame:
    """The clean pipeline on a stream (a stateless projection)."""
    return clean_table(df, specs)


def filter_stream(df: DataFrame, conditions: list[dict | FilterRange], combine_mode: str = "OR") -> DataFrame:
    """The analyze tool's filter on a stream (stateless)."""
    return filter_rows(df, conditions, combine_mode)


def running_totals(df: DataFrame, group_cols: list[str], sum_col: str) -> DataFrame:
    """``record_count`` and ``total_amount`` per group, kept up to date as files arrive.

    Partial aggregation happens per micro-batch before the shuffle; the state
    holds one row per group. Sorting is left to the reader of the result.
    """
    return aggregate(df, group_cols, sum_col, sort_by=None)


def run_available(df: DataFrame, output_path: str, output_mode: str = "append",
                  checkpoint_location: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Process every file available now, then stop (``trigger(availableNow=True)``).

    ``append`` writes new rows with the exactly-once file sink. ``complete``
    (for running totals) rewrites the whole current result each micro-batch,
    which is idempotent when a batch is replayed after a failure.
    """
    spark = df.sparkSession
    checkpoint = checkpoint_location or scratch_path(spark, "stream-state")
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if output_mode == "complete":
        def overwrite(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").format(fmt).save(output_path)
        writer = writer.foreachBatch(overwrite)
    else:
        writer = writer.format(fmt).option("path", output_path)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
