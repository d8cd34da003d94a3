"""Readers, writers and inspection helpers."""

from .files import (
    CSV_WRITE_OPTIONS,
    ExportError,
    csv_layouts,
    export_results,
    export_table,
    load_files,
    read_csv,
    read_table,
    result_path,
    sniff_delimiter,
    write_csv,
    write_parquet,
)
from .inspect import columns, preview, row_count, schema_info, sql_type_name

__all__ = [
    "CSV_WRITE_OPTIONS", "ExportError", "columns", "csv_layouts", "export_results", "export_table", "load_files", "preview",
    "read_csv", "read_table", "result_path", "row_count", "schema_info", "sniff_delimiter", "sql_type_name",
    "write_csv", "write_parquet",
]
