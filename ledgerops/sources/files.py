"""CSV and Parquet reading and writing, and export of result sets.

Reading is string-first: every CSV column is text unless a schema is given or
inference is asked for, and the cleaners turn text into numbers, dates and
booleans by an explicit spec (no per-file guessing that differs by file).

The layout (delimiter, header, column order, line breaks inside quotes) is found
for each file on its own; files of one layout are read together. A record whose
number of fields differs from its file's header is an error, or is kept visible,
but never cut or padded silently.

Writers produce one directory of part files per table (parallel, one file per
task); ``single_file=True`` funnels the table through one task and is only for
small outputs.
"""

from __future__ import annotations

import csv
import io
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import NUMBER_TEXT, parse_date
from ..functions.names import column
from ..operators import reconciliation as rc
from ..operators.aggregation import check_same_columns, union_all
from ..operators.clean import columns_to_text
from ..operators.reconciliation import RESULT_FILE_NAMES, Reconciliation
from ..session import checkpoint_dir
from .types import infer_types

# CSV text conventions of the written files (header, comma,
# NULL as an empty field, an empty string as "", quotes doubled, blanks kept).
CSV_WRITE_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# Delimiters recognised when a CSV's delimiter is not given.
CSV_DELIMITERS = (",", ";", "\t", "|")
READ_THREADS = 32    # columns of Parquet files that are read at the same time
REJECTED = "_rejected"
# Stands for an empty unquoted field (NULL) while reading, so that a quoted empty field stays empty text.
NO_VALUE = "\ue000NULL\ue000"


@dataclass(frozen=True)
class Layout:
    """How one CSV file is written."""

    sep: str
    header: bool
    names: tuple[str, ...]
    multi_line: bool


def delimiter_of(record: str) -> str:
    """The delimiter of a record: the candidate that occurs most often outside double quotes (a tie: the comma)."""
    outside, quoted = [], False
    for ch in record:
        if ch == '"':
            quoted = not quoted
        elif not quoted:
            outside.append(ch)
    counts = {d: outside.count(d) for d in CSV_DELIMITERS}
    best = max(CSV_DELIMITERS, key=lambda d: (counts[d], d == ","))
    return best if counts[best] > 0 else ","


def _data_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The data files of paths, folders and globs, in the order given (a listing on the driver, no job)."""
    return [_path(f) for p in paths for f in sorted(spark.read.text(p).inputFiles())]


def _path(uri: str) -> str:
    """The plain path of a file's URI: blanks and signs that a URI encodes stand for themselves in it."""
    return unquote(uri).replace("file:///", "file:/")


def _literal(paths: list[str]) -> list[str]:
    """Paths whose signs are not read as a glob."""
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths]


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, id, value, quotes): the lines of the files; (block, id) is their order within a file.

    Lines end at a line feed; a carriage return before it stays part of the line."""
    return spark.read.option("lineSep", "\n").text(_literal(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def _heads(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, head, broken): the first line of every file that is not blank, and whether any line has an odd number of quotes."""
    odd, filled = F.col("quotes") % 2 == 1, F.ltrim("value", F.lit(" \ufeff\r\t")) != ""
    # the least struct alone would sort all lines by their file; beside a collected set it is held in a hash table
    return _lines(spark, files).where(filled).groupBy("file").agg(
        F.min(F.struct(F.struct("block", "id").alias("at"), "value", odd.alias("open"))).alias("head"),
        F.array_contains(F.collect_set(odd), True).alias("broken"))


def _first_records(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, bool]]:
    """The first record of every file that has one, and whether any of its quotes runs over a line break.

    One pass over all files finds the first lines that are not blank and the files
    that have a line with an odd number of quotes. Where the first line leaves a quote
    open, the record goes on to the next such line: two more passes for those files."""
    if not files:
        return {}
    at, odd = F.struct("block", "id"), F.col("quotes") % 2 == 1
    out, open_heads = {}, []
    for file, head, broken in _heads(spark, files).collect():  # one row per file, as in the listing
        out[_path(file)] = (head["value"], broken)
        if head["open"]:
            open_heads.append((file, head["at"]["block"], head["at"]["id"]))
    if open_heads:
        begun = spark.createDataFrame(open_heads, "f string, b long, i long")
        later = _lines(spark, [_path(f) for f, _, _ in open_heads]).join(begun, F.col("file") == F.col("f")).where(at >= F.struct("b", "i"))
        ends = later.where(odd & (at > F.struct("b", "i"))).groupBy(F.col("file").alias("g")).agg(F.min(at).alias("end"))
        whole = later.join(ends, F.col("file") == F.col("g")).where(at <= F.col("end")).groupBy("file").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n"))
        closed = {_path(f): record for f, record in whole.collect()}
        for file, _, _ in open_heads:
            if _path(file) not in closed:
                raise ValueError(f"{_path(file)}: the quote opened in the first record is not closed")
            out[_path(file)] = (closed[_path(file)], True)
    return {f: (record.removeprefix("\ufeff").removesuffix("\r"), broken) for f, (record, broken) in out.items()}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of one CSV file, from its first record."""
    records = _first_records(spark, _data_files(spark, [path]))
    return delimiter_of(next(iter(records.values()))[0]) if records else ","


def _value_records(spark: SparkSession, records: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Those of the first records that hold values: an empty field, a repeated one, a number or a date is no column
    name. All fields are tried in one job."""
    found = {r for r in records if len({f.lower() for f in r}) < len(r) or any(not f.strip() for f in r)}
    rest = sorted(records - found)
    if rest:
        fields = spark.createDataFrame([(i, f) for i, r in enumerate(rest) for f in r], "i int, f string")
        # one branch of the expression for all fields, as the cleaners parse them
        values = fields.where(F.col("f").rlike(NUMBER_TEXT) | parse_date(F.col("f")).isNotNull()).select("i").distinct()
        found |= {rest[r[0]] for r in values.collect()}
    return found


def csv_layouts(spark: SparkSession, paths: list[str], sep: str | None = None, header: bool | None = None,
                multi_line: bool | None = None) -> dict[str, Layout]:
    """The layout of every file that has a record, by its plain path.

    A fixed number of jobs, however many files there are: one pass over the text
    for first records and quotes that run over a line break, two more where a first
    record does so itself, and one that tells column names from values."""
    files = _data_files(spark, paths)
    records = _first_records(spark, list(dict.fromkeys(files)))
    seps = {f: sep or delimiter_of(records[f][0]) for f in files if f in records}
    fields = {f: tuple(next(csv.reader(io.StringIO(records[f][0], newline=""), delimiter=seps[f]))) for f in seps}
    values = _value_records(spark, set(fields.values())) if header is None else set() if header else set(fields.values())
    return {f: Layout(seps[f], fields[f] not in values,
                      tuple(f"column{i}" for i in range(len(fields[f]))) if fields[f] in values else fields[f],
                      records[f][1] if multi_line is None else multi_line) for f in seps}


def _records(spark: SparkSession, files: list[str], header: bool) -> DataFrame:
    """(value): the records of files whose quoted fields run over line breaks, without their headers.

    Blocks of a file are read side by side. Sums of quotes per block, added up over a
    file's blocks, tell each block whether it begins inside a quote; within a block
    running sums do the same for each line. Only the lines of records that run over a
    line break are brought together."""
    lines = _lines(spark, files)
    totals = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("quotes").over(blocks), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(carried, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).withColumn(
        "inside", (F.col("before") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2 == 1)
    whole = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    # a record of several lines opens with a line that is not inside and ends with the next odd one
    opens = F.when(~F.col("inside") & (F.col("quotes") % 2 == 1), F.struct("block", "id"))
    up_to = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    opened = placed.where(~whole).withColumn("start", F.last(opens, ignorenulls=True).over(up_to))
    last = opened.groupBy("file", "block").agg(F.max("start").alias("start"))
    begun = last.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.last("start", ignorenulls=True).over(blocks).alias("_start"))
    joined = opened.join(begun, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select(
        "file", F.coalesce("start", "_start").alias("at"), F.struct("block", "id", "value").alias("line"))
    long = joined.groupBy("file", "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "\n").alias("value"))
    short = placed.where(whole).select("file", F.struct("block", "id").alias("at"), "value")
    blank = F.trim(F.translate("value", "\ufeff\r", "")) == ""
    records = short.unionByName(long).where(~blank)
    if header:
        first = records.groupBy(F.col("file").alias("f")).agg(F.min("at").alias("first"))
        records = records.join(first, F.col("file") == F.col("f")).where(F.col("at") != F.col("first"))
    return records.select(F.regexp_replace(F.ltrim(F.col("value"), F.lit("\ufeff")), "\r$", "").alias("value"))


def _read_layout(spark: SparkSession, files: list[str], layout: Layout, schema, keep_rejected: bool) -> DataFrame:
    options = {"sep": layout.sep, "quote": '"', "escape": '"', "nullValue": NO_VALUE}
    paths = _literal(files)
    reader = (spark.read.options(**options).option("header", str(layout.header).lower())
              .option("multiLine", str(layout.multi_line).lower()).option("enforceSchema", "false").option("columnPruning", "false"))
    if schema is not None:
        given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        by_name = {f.name.lower(): f for f in given.fields}
        if layout.header and {n.lower() for n in layout.names} != set(by_name):
            raise ValueError(f"{files[0]} has the columns {list(layout.names)}, not {[f.name for f in given.fields]}")
        fields = [by_name[n.lower()] for n in layout.names] if layout.header else given.fields
    else:
        fields = [T.StructField(n, T.StringType()) for n in layout.names]
    kind = T.StructType([*fields, T.StructField(REJECTED, T.StringType())] if keep_rejected else fields)
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED} if keep_rejected else {"mode": "FAILFAST"}
    if layout.multi_line:
        parsed = _records(spark, files, layout.header).select(F.from_csv("value", _ddl(kind), {**options, **mode}).alias("r"))
        return parsed.select(*[F.col("r").getField(f.name).alias(f.name) for f in kind.fields])
    return reader.schema(kind).options(**mode).csv(paths)


def _ddl(kind: T.StructType) -> str:
    """A schema as DDL text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kind.fields)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             infer_schema: bool = False, sep: str | None = None, header: bool | None = None,
             multi_line: bool | None = None, keep_rejected: bool = False) -> DataFrame:
    """Read CSV file(s), folders or globs. Columns are text unless ``schema`` or ``infer_schema``.

    Delimiter, header and line breaks inside quotes are found per file unless
    given; a file without a header gets the names column0, column1, ... Files
    may list the same columns in different orders (the first file's order is
    kept); other columns are an error that names the file. Quotes inside quoted
    fields are doubled (RFC 4180). Files are read in blocks, also those with line
    breaks inside quotes. Any path will do: blanks, ``%``, ``#`` and the signs of
    globs in the names of files found are taken as they are.

    With ``infer_schema`` each column gets the narrowest type that all its values
    in all files can be (see ``types.KINDS``): one more pass over the files, and
    blank texts are NULL in columns that are not text. A ``schema`` goes first.

    A record with more or fewer fields than its file's header stops the read,
    with the record in the message. With ``keep_rejected`` it is kept instead,
    its text in the column ``_rejected`` (NULL in good rows).
    """
    paths = [path] if isinstance(path, str) else list(path)
    layouts = csv_layouts(spark, paths, sep, header, multi_line)
    if not layouts:
        given = T.StructType() if schema is None else schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return spark.createDataFrame([], given)
    groups: dict[Layout, list[str]] = {}
    for f, layout in layouts.items():
        groups.setdefault(layout, []).append(f)
    frames = [_read_layout(spark, files, layout, schema, keep_rejected) for layout, files in groups.items()]
    check_same_columns(frames, [files[0] for files in groups.values()])
    rows = union_all(frames, validate=False)
    return infer_types(rows, REJECTED if keep_rejected else None) if infer_schema and schema is None else rows


def read_table(spark: SparkSession, path: str | list[str], fmt: str | None = None, **options) -> DataFrame:
    """Read CSV or Parquet (by ``fmt`` or by the path's extension)."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or ("csv" if first.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        return read_csv(spark, path, **options)
    return spark.read.options(**options).format(fmt).load(path)


def load_files(spark: SparkSession, paths: list[str], fmt: str | None = None, by: str = "name",
               **options) -> DataFrame:
    """Load several same-schema files and stack them (first file fixes the column order).

    Every file's columns are checked against the first file's before rows are
    read, and a mismatch names the file. Files of one layout are then read
    together by one multi-path read, so a thousand monthly files with one layout
    give a one-branch plan instead of a thousand-way union.
    """
    if not paths:
        raise ValueError("no files given")
    kind = fmt or ("csv" if paths[0].lower().endswith(".csv") else "parquet")
    if kind == "csv" and by == "name":
        return read_csv(spark, paths, **options)
    typed = kind == "csv" and options.pop("infer_schema", False) and options.get("schema") is None
    with ThreadPoolExecutor(max_workers=READ_THREADS) as pool:  # one small read of columns each
        frames = list(pool.map(lambda p: read_table(spark, p, kind, **options), paths))
    check_same_columns(frames, paths)
    groups: dict[tuple, list[str]] = {}
    for p, df in zip(paths, frames):
        groups.setdefault(tuple(df.dtypes), []).append(p)
    rows = union_all([read_table(spark, group, kind, **options) for group in groups.values()], by=by, validate=False)
    return infer_types(rows, REJECTED if options.get("keep_rejected") else None) if typed else rows


def as_csv_text(df: DataFrame) -> DataFrame:
    """Render values whose CSV text would differ from the ledger SQL's: FLOAT and
    DOUBLE in plain notation, local timestamps as ``yyyy-MM-dd HH:mm:ss[.f]``."""
    plain = columns_to_text(df, [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))])
    local = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return plain.withColumns({n: column(n).cast("string") for n in local}) if local else plain


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite",
              plain_text: bool = True, sep: str = ",") -> int:
    """Write a table as CSV part files under ``path`` (a directory); returns the number of rows written,
    which the write itself counts."""
    out = as_csv_text(df) if plain_text else df
    if single_file:
        out = out.coalesce(1)
    written = Observation()
    out.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**{**CSV_WRITE_OPTIONS, "sep": sep}).csv(path)
    return written.get["rows"]


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def result_path(out_dir: str, table: str) -> str:
    """Output location of one named result; unknown names get ``<name>.csv``."""
    return f"{out_dir.rstrip('/')}/{RESULT_FILE_NAMES.get(table, f'{table}.csv')}"


class ExportError(RuntimeError):
    """Some result sets could not be written; ``failed`` has the cause of each, ``written`` the others' paths."""

    def __init__(self, failed: dict[str, Exception], written: dict[str, str]):
        super().__init__("not exported: " + "; ".join(f"{name} ({cause})" for name, cause in failed.items()))
        self.failed, self.written = failed, written


def export_table(df: DataFrame, out_dir: str, table: str, **kwargs) -> tuple[str, int]:
    """Write one named result; returns its path and its number of rows."""
    path = result_path(out_dir, table)
    return path, write_csv(df, path, **kwargs)


def export_results(recon: Reconciliation, out_dir: str, **kwargs) -> dict[str, tuple[str, int]]:
    """Write all five result sets; returns path and row count of each.

    All sets are tried; if any fails, one ``ExportError`` names them at the end.
    The matched pairs are checkpointed once (to the shared checkpoint folder,
    see ``session.checkpoint_dir``) so the three matched sets are written
    without running the join again, and a lost executor does not force the
    join to be recomputed.
    """
    checkpoint_dir(recon.a.sparkSession)
    pairs = recon.pairs.checkpoint(eager=True)
    tables = {
        "exact_matches": rc.exact_from(pairs),
        "matches_with_date_note": rc.date_note_from(pairs),
        "amount_variances": rc.variance_from(pairs),
        "missing_in_b": recon.missing_in_b,
        "missing_in_a": recon.missing_in_a,
    }
    written, failed = {}, {}
    # The five writes are independent jobs: their tasks run side by side.
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        futures = {name: pool.submit(export_table, frame, out_dir, name, **kwargs) for name, frame in tables.items()}
        for name, future in futures.items():
            if (cause := future.exception()) is not None:
                failed[name] = cause
            else:
                written[name] = future.result()
    if failed:
        raise ExportError(failed, {name: path for name, (path, _) in written.items()})
    return written
