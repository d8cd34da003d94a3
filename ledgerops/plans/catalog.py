"""Registered queries: one per tool operation, each with its oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the given Parquet tables (or data
Spark derives from them) in full and returns a lazy DataFrame. Money sums that
are compared across engines are rounded to cents (or summed as DECIMAL) so
that the order of floating point additions cannot change the digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as fc
from ..operators import aggregation as agg
from ..operators import analysis as an
from ..operators import clean as cl
from ..operators import filters as fl
from ..operators import profile as pr
from ..operators import reconciliation as rc
from ..sources import files as io
from ..sources import inspect as ins
from ..session import computed, scratch_path
from .. import streaming as st
from . import inputs as I
from . import oracle_sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def _ledgers(spark: SparkSession, sf_dir: str) -> rc.Reconciliation:
    return rc.reconcile(I.ledger_a(spark, sf_dir), I.ledger_b(spark, sf_dir), I.LEDGER_CONFIG)


TOL = I.TOLERANCE
PAIR_SELECT = ("a.k AS match_key, a.d AS date_a, b.d AS date_b, a.amt AS amount_a, b.amt AS amount_b, "
               "a.memo AS description_a, b.memo AS description_b")

# -- reconcile --------------------------------------------------------------------


@register("recon_summary", S.summary_sql(I.LEDGERS_SQL, "ledger_a", "ledger_b", TOL))
def recon_summary(spark, sf_dir):
    return _ledgers(spark, sf_dir).summary()


@register("recon_exact", f"""WITH {I.LEDGERS_SQL}
SELECT {PAIR_SELECT} FROM ledger_a a JOIN ledger_b b ON a.k = b.k
WHERE a.d = b.d AND ABS(a.amt - b.amt) <= {TOL}""")
def recon_exact(spark, sf_dir):
    return _ledgers(spark, sf_dir).exact_matches


@register("recon_date_note", f"""WITH {I.LEDGERS_SQL}
SELECT {PAIR_SELECT}, 'Date mismatch' AS note FROM ledger_a a JOIN ledger_b b ON a.k = b.k
WHERE a.d <> b.d AND ABS(a.amt - b.amt) <= {TOL}""")
def recon_date_note(spark, sf_dir):
    return _ledgers(spark, sf_dir).matches_with_date_note


@register("recon_variance", f"""WITH {I.LEDGERS_SQL}
SELECT a.k AS match_key, a.d AS date_a, b.d AS date_b, a.amt AS amount_a, b.amt AS amount_b,
       ABS(a.amt - b.amt) AS variance, a.memo AS description_a, b.memo AS description_b
FROM ledger_a a JOIN ledger_b b ON a.k = b.k WHERE ABS(a.amt - b.amt) > {TOL}""")
def recon_variance(spark, sf_dir):
    return _ledgers(spark, sf_dir).amount_variances


@register("recon_missing_in_b", f"""WITH {I.LEDGERS_SQL}
SELECT a.* FROM ledger_a a LEFT JOIN ledger_b b ON a.k = b.k WHERE b.k IS NULL""")
def recon_missing_in_b(spark, sf_dir):
    return _ledgers(spark, sf_dir).missing_in_b


@register("recon_missing_in_a", f"""WITH {I.LEDGERS_SQL}
SELECT b.* FROM ledger_b b LEFT JOIN ledger_a a ON b.k = a.k WHERE a.k IS NULL""")
def recon_missing_in_a(spark, sf_dir):
    return _ledgers(spark, sf_dir).missing_in_a


EXPORT_SELECT = """SELECT '{file}' AS file, CAST({k} AS VARCHAR) AS match_key, {da} AS date_a, {db} AS date_b,
  {xa} AS amount_a, {xb} AS amount_b, {note} AS note, count(*) AS copies"""


def _export_sql() -> str:
    pair = dict(k="a.k", da="CAST(a.d AS VARCHAR)", db="CAST(b.d AS VARCHAR)", xa="a.amt", xb="b.amt")
    one = {"a": dict(k="a.k", da="CAST(a.d AS VARCHAR)", db="NULL", xa="a.amt", xb="NULL"),
           "b": dict(k="b.k", da="NULL", db="CAST(b.d AS VARCHAR)", xa="NULL", xb="b.amt")}
    joined = " FROM ledger_a a JOIN ledger_b b ON a.k = b.k WHERE "
    parts = [
        EXPORT_SELECT.format(file="exact_matches.csv", note="a.memo", **pair) + joined + f"a.d = b.d AND ABS(a.amt - b.amt) <= {TOL}",
        EXPORT_SELECT.format(file="matches_with_date_note.csv", note="'Date mismatch'", **pair) + joined
        + f"a.d <> b.d AND ABS(a.amt - b.amt) <= {TOL}",
        EXPORT_SELECT.format(file="amount_variances.csv", note="b.memo", **pair) + joined + f"ABS(a.amt - b.amt) > {TOL}",
        EXPORT_SELECT.format(file="missing_in_source_b.csv", note="a.memo", **one["a"])
        + " FROM ledger_a a LEFT JOIN ledger_b b ON a.k = b.k WHERE b.k IS NULL",
        EXPORT_SELECT.format(file="missing_in_source_a.csv", note="b.memo", **one["b"])
        + " FROM ledger_b b LEFT JOIN ledger_a a ON b.k = a.k WHERE a.k IS NULL",
    ]
    return f"WITH {I.LEDGERS_SQL}" + " UNION ALL ".join(p + " GROUP BY ALL" for p in parts)


@register("recon_export", _export_sql())
def recon_export(spark, sf_dir):
    """Export the five result sets as CSV (shared scratch folder) and read every value back."""
    recon = _ledgers(spark, sf_dir)
    written = io.export_results(recon, scratch_path(spark, "recon-export"))
    layout = {  # columns of each file: key, dates, amounts, note
        "exact_matches": ("match_key", "date_a", "date_b", "amount_a", "amount_b", "description_a"),
        "matches_with_date_note": ("match_key", "date_a", "date_b", "amount_a", "amount_b", "note"),
        "amount_variances": ("match_key", "date_a", "date_b", "amount_a", "amount_b", "description_b"),
        "missing_in_b": ("k", "d", None, "amt", None, "memo"),
        "missing_in_a": ("k", None, "d", None, "amt", "memo"),
    }
    names = ("match_key", "date_a", "date_b", "amount_a", "amount_b", "note")
    kinds = ("string", "string", "string", "double", "double", "string")
    parts = []
    for name, (path, _) in written.items():
        back = io.read_csv(spark, path, header=True, multi_line=False)
        cols = [(F.col(c) if c else F.lit(None)).cast(kind).alias(n) for c, n, kind in zip(layout[name], names, kinds)]
        parts.append(back.select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), *cols))
    return agg.union_all(parts).groupBy("file", *names).agg(F.count(F.lit(1)).alias("copies"))


def _mixed_keys_sql() -> str:
    cases = {"whole and floating": ("ledger_a", "float_b"), "whole and text": ("ledger_a", "text_b"),
             "whole and decimal text": ("ledger_a", "halves_b"), "whole and large decimal": ("ledger_a", "large_b"),
             "date and timestamp": ("day_a", "day_b")}
    return " UNION ALL ".join(f"SELECT '{c}' AS keys, * FROM ({S.summary_sql(I.MIXED_KEYS_SQL, a, b, TOL)})"
                              for c, (a, b) in cases.items())


@register("recon_mixed_keys", _mixed_keys_sql())
def recon_mixed_keys(spark, sf_dir):
    """Sources whose keys have unlike types. One case is computed at a time, so that only its shuffle files are on disk."""
    cases = [computed(rc.reconcile(a, b, I.LEDGER_CONFIG).summary().select(F.lit(name).alias("keys"), "*"))
             for name, (a, b) in I.mixed_key_sources(spark, sf_dir).items()]
    return agg.union_all(cases)


@register("key_candidates_mixed", f"""WITH {I.MIXED_KEYS_SQL}
SELECT 0 AS position, 'k' AS "column", (SELECT count(*) FILTER (WHERE k IS NULL) FROM ledger_a) AS a_nulls,
  (SELECT count(DISTINCT k) FROM ledger_a) AS a_distinct,
  (SELECT count(*) FILTER (WHERE k IS NULL) FROM text_b) AS b_nulls, (SELECT count(DISTINCT k) FROM text_b) AS b_distinct,
  (SELECT count(DISTINCT k) FROM ledger_a WHERE k IN (SELECT k FROM text_b)) AS a_keys_in_b,
  (SELECT count(DISTINCT k) FROM ledger_a WHERE k IN (SELECT k FROM text_b))
    / (SELECT count(DISTINCT k) FROM ledger_a) AS a_key_share""")
def key_candidates_mixed(spark, sf_dir):
    """Key candidates where one side has the key as zero-padded text."""
    a, b = I.mixed_key_sources(spark, sf_dir)["whole and text"]
    return pr.key_candidates(a, b, columns=["K"])


@register("recon_text_sources", S.summary_sql(
    I.LEDGERS_TEXT_SQL.strip() + f""",
clean_a AS (SELECT k, {S.date_sql('d')} AS d, {S.amount_sql('amt')} AS amt FROM text_a),
clean_b AS (SELECT k, {S.date_sql('d')} AS d, {S.amount_sql('amt')} AS amt FROM text_b)""",
    "clean_a", "clean_b", TOL))
def recon_text_sources(spark, sf_dir):
    """The whole reconcile tool on text exports: clean amounts and dates, then reconcile."""
    recon = rc.reconcile_sources(I.ledger_a_text(spark, sf_dir), I.ledger_b_text(spark, sf_dir),
                                 I.LEDGER_CONFIG, auto_clean=True)
    return recon.summary()


@register("recon_gaps_summary", S.summary_sql(I.LEDGERS_GAPS_SQL, "gaps_a", "gaps_b", TOL))
def recon_gaps_summary(spark, sf_dir):
    """Sources with NULL keys, dates and amounts: unclassified pairs and NULL keys counted."""
    recon = rc.reconcile(I.ledger_a_gaps(spark, sf_dir), I.ledger_b_gaps(spark, sf_dir), I.LEDGER_CONFIG)
    return recon.summary()


@register("recon_gaps_missing_in_b", f"""WITH {I.LEDGERS_GAPS_SQL}
SELECT a.* FROM gaps_a a LEFT JOIN gaps_b b ON a.k = b.k WHERE b.k IS NULL""")
def recon_gaps_missing_in_b(spark, sf_dir):
    recon = rc.reconcile(I.ledger_a_gaps(spark, sf_dir), I.ledger_b_gaps(spark, sf_dir), I.LEDGER_CONFIG)
    return recon.missing_in_b


@register("recon_source_totals", f"""WITH {I.LEDGERS_TEXT_SQL.strip()}
SELECT (SELECT {S.exact_sum_sql(S.amount_sql('amt'))} FROM text_a) AS total_a,
       (SELECT {S.exact_sum_sql(S.amount_sql('amt'))} FROM text_b) AS total_b""")
def recon_source_totals(spark, sf_dir):
    """Amount totals of both text sources after auto-cleaning (shown before a run)."""
    a, b = rc.clean_sources(I.ledger_a_text(spark, sf_dir), I.ledger_b_text(spark, sf_dir), I.LEDGER_CONFIG,
                            clean_dates=False)
    return rc.reconcile(a, b, I.LEDGER_CONFIG).source_totals()


@register("recon_orders_vs_lines", S.summary_sql(
    I.LEDGERS_SQL.strip() + "," + I.ORDER_TOTALS_SQL, "ledger_a", "order_totals", TOL))
def recon_orders_vs_lines(spark, sf_dir):
    """Order headers against the exact sum of their lines."""
    recon = rc.reconcile(I.ledger_a(spark, sf_dir), I.order_totals(spark, sf_dir), I.LEDGER_CONFIG)
    return recon.summary()


@register("recon_duplicate_keys", S.summary_sql(I.LINES_SQL, "lines_a", "lines_b", TOL))
def recon_duplicate_keys(spark, sf_dir):
    """Line-level sources keyed by order: every pair of lines of an order is compared."""
    recon = rc.reconcile(I.lines_a(spark, sf_dir), I.lines_b(spark, sf_dir), I.LEDGER_CONFIG)
    return recon.summary()


# -- cleaning ------------------------------------------------------------------------


@register("clean_amount", f"""WITH {I.AMOUNT_TEXTS_SQL}
SELECT l_orderkey, l_linenumber, raw, {S.amount_sql('raw')} AS amount FROM amount_texts""")
def clean_amount(spark, sf_dir):
    t = I.amount_texts(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "raw", fc.clean_amount("raw").alias("amount"))


@register("clean_date", f"""WITH {I.DATE_TEXTS_SQL}
SELECT o_orderkey, raw, {S.date_sql('raw')} AS cleaned FROM date_texts""")
def clean_date(spark, sf_dir):
    t = I.date_texts(spark, sf_dir)
    return t.select("o_orderkey", "raw", fc.clean_date("raw").alias("cleaned"))


@register("clean_boolean", f"""WITH {I.FLAG_TEXTS_SQL}
SELECT doc_id, raw, {S.boolean_sql('raw')} AS quality_flag, {S.boolean_sql('toxic')} AS toxic_flag
FROM flag_texts""")
def clean_boolean(spark, sf_dir):
    t = I.flag_texts(spark, sf_dir)
    return t.select("doc_id", "raw", fc.clean_boolean("raw").alias("quality_flag"),
                    fc.clean_boolean("toxic").alias("toxic_flag"))


@register("format_date", f"""WITH {I.DATE_TEXTS_SQL}
SELECT o_orderkey,
  {S.format_date_sql(S.date_sql('raw'), 'YYYY-MM-DD')} AS iso,
  {S.format_date_sql(S.date_sql('raw'), 'DD/MM/YYYY')} AS day_first,
  {S.format_date_sql(S.date_sql('raw'), 'MM/DD/YYYY')} AS month_first,
  {S.format_date_sql(S.date_sql('raw'), 'DD-MMM-YYYY')} AS day_month_name
FROM date_texts""")
def format_date(spark, sf_dir):
    t = I.date_texts(spark, sf_dir)
    # cleaned once, parsed once, then written four ways
    days = t.select("o_orderkey", fc.clean_date("raw").alias("raw")).select("o_orderkey", fc.parse_date("raw").alias("day"))
    formats = {"iso": "YYYY-MM-DD", "day_first": "DD/MM/YYYY", "month_first": "MM/DD/YYYY", "day_month_name": "DD-MMM-YYYY"}
    return days.select("o_orderkey", *[fc.format_date("day", f, days.schema["day"].dataType).alias(n) for n, f in formats.items()])


@register("clean_amount_numeric", """
SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_extendedprice * 1e12 AS huge, l_discount / 1e5 AS tiny,
       CAST(l_orderkey AS DOUBLE) AS whole, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE) AS exact
FROM lineitem""")
def clean_amount_numeric(spark, sf_dir):
    """The amount cleaner on columns that are numbers already, by name alone."""
    li = I.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * 1e12).alias("huge"), (F.col("l_discount") / 1e5).alias("tiny"),
        F.col("l_orderkey").alias("whole"), F.col("l_quantity").cast("decimal(12,2)").alias("exact"))
    return li.select("l_orderkey", "l_linenumber", *[fc.clean_amount(c).alias(c) for c in ("price", "huge", "tiny", "whole", "exact")])


@register("format_number", """
SELECT c_custkey, round(CAST(c_acctbal AS DOUBLE), 0) AS acct_0, round(CAST(c_acctbal AS DOUBLE), 2) AS acct_2,
       round(CAST(c_acctbal AS DOUBLE), 3) AS acct_3, round(CAST(c_acctbal AS DOUBLE), 4) AS acct_4
FROM customer""")
def format_number(spark, sf_dir):
    c = I.table(spark, sf_dir, "customer")
    return c.select("c_custkey", *[fc.format_number("c_acctbal", fc.precision_of(f)).alias(f"acct_{fc.precision_of(f)}")
                                   for f in ("0", "0.00", "0.000", "0.0000")])


@register("format_number_net", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 0) AS net_0,
       round(l_extendedprice * (1 - l_discount), 1) AS net_1, round(l_extendedprice * (1 - l_discount), 2) AS net_2
FROM lineitem""")
def format_number_net(spark, sf_dir):
    """Net prices have up to four decimals, so many values sit on a rounding tie."""
    li = I.table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber",
                     *[fc.format_number(net, p).alias(f"net_{p}") for p in (0, 1, 2)])


MIXED_SPECS = [
    cl.ColumnSpec("id", True, "Text"),
    cl.ColumnSpec("trans_date", True, "Date", "DD-MMM-YYYY"),
    cl.ColumnSpec("amount", True, "Number", "0.00"),
    cl.ColumnSpec("active", True, "Boolean"),
    cl.ColumnSpec("memo", False, "Text"),
]


@register("clean_pipeline", f"""WITH {I.MIXED_TABLE_SQL}
SELECT id, {S.format_date_sql(S.date_sql('trans_date'), 'DD-MMM-YYYY')} AS trans_date,
       round(CAST({S.amount_sql('amount')} AS DOUBLE), 2) AS amount,
       {S.boolean_sql('active')} AS active
FROM mixed""")
def clean_pipeline(spark, sf_dir):
    return cl.clean_table(I.mixed_table(spark, sf_dir), MIXED_SPECS)


@register("cast_text", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer""")
def cast_text(spark, sf_dir):
    df = I.table(spark, sf_dir, "customer")
    for name in ("c_custkey", "c_nationkey", "c_acctbal"):
        df = cl.transform_column(df, name, "text")
    return df


@register("cast_text_magnitudes", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity / 1e5 AS VARCHAR) AS small, CAST(l_quantity / 1e8 AS VARCHAR) AS tiny,
       CAST(-l_quantity * 1e9 AS VARCHAR) AS large, CAST(l_quantity * 1e15 AS VARCHAR) AS huge,
       CAST(l_quantity * 1e300 AS VARCHAR) AS vast
FROM lineitem""")
def cast_text_magnitudes(spark, sf_dir):
    """Numbers of all magnitudes as text."""
    q = F.col("l_quantity")
    df = I.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (q / 1e5).alias("small"), (q / 1e8).alias("tiny"), (-q * 1e9).alias("large"),
        (q * 1e15).alias("huge"), (q * 1e300).alias("vast"))
    return cl.columns_to_text(df, ["small", "tiny", "large", "huge", "vast"])


@register("clean_skip_errors", """
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders""")
def clean_skip_errors(spark, sf_dir):
    """A column that cannot be cleaned (an unknown type) stays as it is when errors are skipped."""
    return cl.clean_table(I.table(spark, sf_dir, "orders"), [
        cl.ColumnSpec("o_orderkey"), cl.ColumnSpec("O_TOTALPRICE", True, "Number"),
        cl.ColumnSpec("o_orderstatus", True, "Money")], on_error="skip")


@register("dedupe", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def dedupe(spark, sf_dir):
    li = cl.select_columns(I.table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"])
    return cl.dedupe(li, ["L_SUPPKEY", "l_returnflag", "l_linestatus"])


@register("select_columns", "SELECT c_mktsegment, c_name, c_custkey FROM customer")
def select_columns(spark, sf_dir):
    return cl.select_columns(I.table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name", "c_custkey"])


# -- filters and analysis ----------------------------------------------------------------


@register("filter_between", "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def filter_between(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return fl.filter_rows(o, [fl.FilterRange("amount", "o_totalprice", "100000", "200000")])


@register("filter_equals", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return fl.filter_rows(o, [{"column": "o_orderstatus", "value": "F"}])


@register("filter_date_range", "SELECT * FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-03-31'")
def filter_date_range(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return fl.filter_rows(o, [fl.FilterRange("date", "o_orderdate", "1996-01-01", "1996-03-31")])


@register("filter_contains", "SELECT * FROM part WHERE p_name LIKE '%ring%' OR p_brand LIKE '%Brand#1_%'")
def filter_contains(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    return fl.filter_rows(p, [fl.FilterRange("text", "p_name", "ring"),
                              {"column": "p_brand", "operator": "contains", "value": "Brand#1_"}], "OR")


@register("filter_compare", """
SELECT * FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 30 AND l_returnflag = 'R' AND l_discount > 0.02 AND l_tax <= 0.05""")
def filter_compare(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    return fl.filter_rows(li, [
        {"column": "l_quantity", "operator": "gte", "value": 10},
        {"column": "l_quantity", "operator": "lt", "value": 30},
        {"column": "l_returnflag", "value": "R"},
        {"column": "l_discount", "operator": "gt", "value": 0.02},
        {"column": "l_tax", "operator": "lte", "value": 0.05},
    ], "AND")


ORDER_FILTERS = [
    fl.FilterRange("amount", "o_totalprice", "100000", "300000"),
    fl.FilterRange("date", "o_orderdate", "1996-01-01", "1997-06-30"),
    fl.FilterRange("text", "o_orderpriority", "URGENT"),
]
ORDER_FILTERS_SQL = ("o_totalprice BETWEEN 100000.0 AND 300000.0 {op} "
                     "o_orderdate BETWEEN '1996-01-01' AND '1997-06-30' {op} o_orderpriority LIKE '%URGENT%'")


@register("filter_and", "SELECT * FROM orders WHERE " + ORDER_FILTERS_SQL.format(op="AND"))
def filter_and(spark, sf_dir):
    return fl.filter_rows(I.table(spark, sf_dir, "orders"), ORDER_FILTERS, "AND")


@register("filter_or", "SELECT * FROM orders WHERE " + ORDER_FILTERS_SQL.format(op="OR"))
def filter_or(spark, sf_dir):
    return fl.filter_rows(I.table(spark, sf_dir, "orders"), ORDER_FILTERS, "OR")


@register("filter_none", "SELECT * FROM orders")
def filter_none(spark, sf_dir):
    return fl.filter_rows(I.table(spark, sf_dir, "orders"), [])


@register("analyze_stats", f"""
SELECT count(*) AS count, {S.exact_sum_sql('o_totalprice')} AS total,
       {S.exact_sum_sql('o_totalprice')} / count(o_totalprice) AS average,
       min(o_totalprice) AS minimum, max(o_totalprice) AS maximum
FROM orders WHERE {ORDER_FILTERS_SQL.format(op='AND')}""")
def analyze_stats(spark, sf_dir):
    result = an.analyze(I.table(spark, sf_dir, "orders"), ORDER_FILTERS, "o_totalprice", "AND")
    return result.stats


@register("safe_total", f"""
SELECT sum(TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE)) AS l_quantity_total,
       sum(TRY_CAST(l_returnflag AS DOUBLE)) AS l_returnflag_total,
       {S.exact_sum_sql('l_extendedprice')} AS l_extendedprice_total
FROM lineitem""")
def safe_total(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("string"))
    return an.safe_total(li, ["l_quantity", "l_returnflag", "l_extendedprice"])


# -- stacking and aggregation ------------------------------------------------------


def _parts(spark, sf_dir) -> list[DataFrame]:
    """One table per year folder; the second lists its columns in another order."""
    frames = [io.read_table(spark, p, "parquet") for p in I.lineitem_parts(spark, sf_dir)]
    frames[1] = frames[1].select(*reversed(frames[1].columns))
    return frames


def _ranked(groups: DataFrame) -> DataFrame:
    """Sorted groups with their place, which makes the order part of the compared values."""
    return agg.with_place(groups).withColumn("place", F.col("place").cast("int"))


@register("union_all", "SELECT * FROM lineitem")
def union_all(spark, sf_dir):
    return agg.union_all(_parts(spark, sf_dir))


@register("load_files", "SELECT * FROM lineitem")
def load_files(spark, sf_dir):
    """The year folders loaded as one table."""
    return io.load_files(spark, I.lineitem_parts(spark, sf_dir), fmt="parquet")


@register("load_files_mixed", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, CAST(l_shipdate AS DATE) AS l_shipdate
FROM lineitem""")
def load_files_mixed(spark, sf_dir):
    """CSV files with two delimiters and two column orders, loaded as one table."""
    wanted = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    paths = I.lineitem_parts(spark, sf_dir)
    out = []
    for i, (sep, order) in enumerate(((",", wanted), (";", wanted[::-1]))):
        out.append(scratch_path(spark, f"lineitem-csv-{i}"))
        io.write_csv(io.load_files(spark, paths[i::2], fmt="parquet").select(*order), out[-1], sep=sep)
    back = io.load_files(spark, out, fmt="csv")
    kinds = ("bigint", "int", "double", "double", "string", "timestamp_ntz")
    typed = back.select(*[F.col(c).cast(kind).alias(c) for c, kind in zip(wanted, kinds)])
    return typed.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@register("load_files_typed", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_returnflag = 'R' AS returned,
       CAST(l_shipdate AS DATE) AS l_shipdate, CAST(l_shipdate - INTERVAL 10 DAY AS DATE) AS due,
       CAST(CAST(l_shipdate AS DATE) + INTERVAL 5 DAY AS TIMESTAMP) AS received,
       CASE WHEN l_linenumber > 1 THEN l_suppkey END AS l_suppkey,
       CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END AS l_partkey
FROM lineitem""")
def load_files_typed(spark, sf_dir):
    """CSV files of two layouts whose types are found from all values together: prices without their cents in some
    files, dates that tell day from month only here and there, receipts with a time in some files only, blank
    numbers, and a column that one text keeps from being a number."""
    shipped, price, key = F.to_date("l_shipdate"), F.col("l_extendedprice"), F.col("l_partkey").cast("string")
    text = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("decimal(18,0)").alias("l_quantity"),
            F.when(price == F.floor(price), price.cast("bigint").cast("string")).otherwise(price.cast("decimal(18,2)").cast("string")).alias("l_extendedprice"),
            "l_returnflag", (F.col("l_returnflag") == "R").alias("returned"), F.date_format(shipped, "dd/MM/yyyy").alias("l_shipdate"),
            F.date_format(F.date_sub(shipped, 10), "M-d-yyyy").alias("due"), F.date_add(shipped, 5).alias("received"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("l_suppkey"),
            F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(key).alias("l_partkey")]
    paths = I.lineitem_parts(spark, sf_dir)
    out = []
    for i, (sep, receipt) in enumerate(((",", "yyyy-MM-dd"), (";", "yyyy-MM-dd HH:mm:ss"))):
        out.append(scratch_path(spark, f"lineitem-typed-{i}"))
        rows = io.load_files(spark, paths[i::2], fmt="parquet").select(*text).withColumn("received", F.date_format("received", receipt))
        io.write_csv(rows.select(*(rows.columns if i else reversed(rows.columns))), out[-1], sep=sep)
    back = io.load_files(spark, out, fmt="csv", infer_schema=True)
    return back.withColumns({"l_quantity": F.col("l_quantity").cast("double"), "l_linenumber": F.col("l_linenumber").cast("int")})


@register("aggregate_by_total", """
SELECT *, row_number() OVER (ORDER BY total_amount DESC NULLS LAST, l_returnflag NULLS LAST, l_linestatus NULLS LAST)::INTEGER AS place
FROM (SELECT l_returnflag, l_linestatus, count(*) AS record_count, sum(l_quantity) AS total_amount
      FROM lineitem GROUP BY l_returnflag, l_linestatus)""")
def aggregate_by_total(spark, sf_dir):
    result = agg.aggregate_tables(_parts(spark, sf_dir), "l_returnflag", "l_quantity", ["l_linestatus"],
                                  sort_by=agg.SORT_BY_TOTAL)
    return _ranked(result.groups)


@register("aggregate_by_count", f"""
SELECT *, row_number() OVER (ORDER BY record_count DESC, l_linenumber NULLS LAST, l_returnflag NULLS LAST)::INTEGER AS place
FROM (SELECT l_linenumber, l_returnflag, count(*) AS record_count, {S.exact_sum_sql('l_extendedprice')} AS total_amount
      FROM lineitem GROUP BY l_linenumber, l_returnflag)""")
def aggregate_by_count(spark, sf_dir):
    li = io.load_files(spark, I.lineitem_parts(spark, sf_dir), fmt="parquet")
    groups = agg.aggregate(li, ["l_linenumber", "l_returnflag"], "l_extendedprice", sort_by=agg.SORT_BY_COUNT)
    return _ranked(groups)


@register("aggregate_by_group", """
SELECT *, row_number() OVER (ORDER BY l_linenumber NULLS LAST, l_returnflag NULLS LAST)::INTEGER AS place
FROM (SELECT l_linenumber, l_returnflag, count(*) AS record_count, sum(l_quantity) AS total_amount
      FROM lineitem GROUP BY l_linenumber, l_returnflag)""")
def aggregate_by_group(spark, sf_dir):
    cols = agg.group_columns("l_linenumber", ["l_returnflag", "l_linenumber"])
    li = io.load_files(spark, I.lineitem_parts(spark, sf_dir), fmt="parquet")
    return _ranked(agg.aggregate(li, cols, "l_quantity", sort_by=agg.SORT_BY_GROUP))


@register("aggregate_caller_order", """
SELECT *, row_number() OVER (ORDER BY l_returnflag DESC NULLS LAST, record_count NULLS LAST, l_linenumber NULLS LAST)::INTEGER AS place
FROM (SELECT l_linenumber, l_returnflag, count(*) AS record_count, sum(l_quantity) AS total_amount
      FROM lineitem GROUP BY l_linenumber, l_returnflag)""")
def aggregate_caller_order(spark, sf_dir):
    """The caller's own order: one column down, another up, ties by the group columns."""
    return _ranked(agg.aggregate(I.table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_returnflag"], "L_QUANTITY",
                                 sort_by=[("l_returnflag", "desc"), ("record_count", "asc")]))


@register("aggregate_by_supplier", f"""
SELECT l_suppkey, count(*) AS record_count, {S.exact_sum_sql('l_extendedprice')} AS total_amount
FROM lineitem GROUP BY l_suppkey""")
def aggregate_by_supplier(spark, sf_dir):
    return agg.aggregate(I.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", sort_by=agg.SORT_BY_COUNT)


@register("grand_total", f"""
SELECT count(*) AS row_count, CAST(sum(record_count) AS BIGINT) AS total_records, {S.exact_sum_sql('total_amount')} AS grand_total
FROM (SELECT l_returnflag, count(*) AS record_count, {S.exact_sum_sql('l_extendedprice')} AS total_amount
      FROM lineitem GROUP BY l_returnflag)""")
def grand_total(spark, sf_dir):
    groups = agg.aggregate(I.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", sort_by=None)
    return agg.grand_total(groups)


@register("top_groups", """
SELECT l_partkey, count(*) AS record_count,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM lineitem GROUP BY l_partkey ORDER BY total_amount DESC, l_partkey LIMIT 10""")
def top_groups(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem").withColumn(
        "l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    groups = agg.aggregate(li, ["l_partkey"], "l_extendedprice", sort_by=None)
    top = agg.top_groups(groups, 10, agg.SORT_BY_TOTAL, ["l_partkey"])
    return top.withColumn("total_amount", F.col("total_amount").cast("double"))


@register("events_by_type", f"""
SELECT event_type, count(*) AS record_count, {S.exact_sum_sql('value')} AS total_amount
FROM events GROUP BY event_type""")
def events_by_type(spark, sf_dir):
    return agg.aggregate(I.table(spark, sf_dir, "events"), ["event_type"], "value", sort_by=agg.SORT_BY_TOTAL)


@register("events_window_filter", """
SELECT * FROM events
WHERE ts BETWEEN '2024-01-01 06:00:00' AND '2024-01-03 12:30:00' AND props LIKE '%"k": 1%'""")
def events_window_filter(spark, sf_dir):
    """Timestamp bounds given as text, combined with a text filter (AND)."""
    return fl.filter_rows(I.table(spark, sf_dir, "events"), [
        fl.FilterRange("date", "ts", "2024-01-01 06:00:00", "2024-01-03 12:30:00"),
        fl.FilterRange("text", "props", '"k": 1'),
    ], "AND")


@register("events_day_totals", f"""
SELECT {S.format_date_sql('ts', 'DD/MM/YYYY')} AS day, count(*) AS record_count,
       {S.exact_sum_sql('value')} AS total_amount
FROM events GROUP BY 1""")
def events_day_totals(spark, sf_dir):
    """Timestamps formatted as days (the date cleaner), then totals per day."""
    ev = I.table(spark, sf_dir, "events")
    days = ev.select(fc.format_date("ts", "DD/MM/YYYY", ev.schema["ts"].dataType).alias("day"), "value")
    return agg.aggregate(days, ["day"], "value", sort_by=agg.SORT_BY_GROUP)


DOCUMENT_FILTERS = [fl.FilterRange("text", "text", "License"), fl.FilterRange("text", "text", "@")]


@register("analyze_documents", """
SELECT count(*) AS count, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS average,
       min(n_chars) AS minimum, max(n_chars) AS maximum
FROM documents WHERE text LIKE '%License%' OR text LIKE '%@%'""")
def analyze_documents(spark, sf_dir):
    """The analyze tool on whole document texts: contains-filters (OR), then length statistics."""
    result = an.analyze(I.table(spark, sf_dir, "documents"), DOCUMENT_FILTERS, "n_chars", "OR")
    return result.stats.withColumn("average", F.round("average", 6))


@register("aggregate_documents", """
SELECT lang, source, count(*) AS record_count, CAST(sum(n_chars) AS BIGINT) AS total_amount
FROM documents GROUP BY lang, source""")
def aggregate_documents(spark, sf_dir):
    cols = agg.group_columns("lang", ["source"])
    return agg.aggregate(I.table(spark, sf_dir, "documents"), cols, "n_chars", sort_by=agg.SORT_BY_COUNT)


# -- inspection, profiles, files ---------------------------------------------------------


def _profile_sql() -> str:
    cols = [("id", "BIGINT"), ("trans_date", "VARCHAR"), ("amount", "VARCHAR"), ("active", "VARCHAR"),
            ("memo", "VARCHAR")]
    roles = {"trans_date": "'date'", "amount": "'amount'", "memo": "'description'"}
    guessed = {"id": "Number", "trans_date": "Date", "amount": "Number", "active": "Text", "memo": "Text"}
    parts = []
    for pos, (name, typ) in enumerate(cols):
        num = name if typ == "BIGINT" else S.amount_sql(name)
        parts.append(f"""
SELECT {pos} AS position, '{name}' AS "column", '{typ}' AS type, count(*) AS rows, count({name}) AS non_null,
  CASE WHEN count({name}) > 0 THEN count({num}) / count({name}) END AS number_share,
  CASE WHEN count({name}) > 0 THEN count({S.parse_date_sql(S.date_sql(name))}) / count({name}) END AS date_share,
  CASE WHEN count({name}) > 0 THEN count({S.boolean_sql(name)}) / count({name}) END AS bool_share,
  CAST({roles.get(name, 'NULL')} AS VARCHAR) AS name_role, '{guessed[name]}' AS guessed_type
FROM mixed""")
    return f"WITH {I.MIXED_TABLE_SQL}" + "\nUNION ALL".join(parts)


@register("column_profile", _profile_sql())
def column_profile(spark, sf_dir):
    return pr.column_profile(I.mixed_table(spark, sf_dir))


def _key_candidates_sql() -> str:
    parts = []
    for pos, name in enumerate(("k", "d", "amt", "memo")):
        parts.append(f"""
SELECT {pos} AS position, '{name}' AS "column",
  (SELECT count(*) FILTER (WHERE {name} IS NULL) FROM ledger_a) AS a_nulls,
  (SELECT count(DISTINCT {name}) FROM ledger_a) AS a_distinct,
  (SELECT count(*) FILTER (WHERE {name} IS NULL) FROM ledger_b) AS b_nulls,
  (SELECT count(DISTINCT {name}) FROM ledger_b) AS b_distinct,
  (SELECT count(DISTINCT {name}) FROM ledger_a WHERE {name} IN (SELECT {name} FROM ledger_b)) AS a_keys_in_b""")
    body = "\nUNION ALL".join(parts)
    return f"""WITH {I.LEDGERS_SQL}, cand AS ({body})
SELECT *, CASE WHEN a_distinct > 0 THEN a_keys_in_b / a_distinct END AS a_key_share FROM cand"""


@register("key_candidates", _key_candidates_sql())
def key_candidates(spark, sf_dir):
    return pr.key_candidates(I.ledger_a(spark, sf_dir), I.ledger_b(spark, sf_dir))


@register("preview_ordered", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_ordered(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return ins.preview(o, 10, ["o_orderkey", "o_totalprice", "o_orderpriority"], order_by=["o_orderkey"])


@register("preview_count", "SELECT count(*) AS rows FROM (SELECT * FROM orders LIMIT 1000)")
def preview_count(spark, sf_dir):
    """The unordered preview: any rows, but exactly as many as asked for."""
    return ins.preview(I.table(spark, sf_dir, "orders")).agg(F.count(F.lit(1)).alias("rows"))


@register("schema_info", """
SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name AS name, column_type AS type, "null" = 'YES' AS nullable
FROM (DESCRIBE SELECT * FROM lineitem)""")
def schema_info(spark, sf_dir):
    return ins.schema_info(spark, I.table(spark, sf_dir, "lineitem"))


COUNTED = ("nation", "customer", "orders", "lineitem", "events")


@register("row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS columns FROM {t}" for t in COUNTED))
def row_counts(spark, sf_dir):
    """Rows and columns of several tables."""
    found = {t: I.table(spark, sf_dir, t) for t in COUNTED}
    return spark.createDataFrame([(t, ins.row_count(df), len(ins.columns(df))) for t, df in found.items()],
                                 "name string, rows long, columns long")


@register("csv_messy_round_trip", """
SELECT doc_id, '  ' || text || ' "quoted, ' || source || '" ' AS body, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS lang,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source, n_chars
FROM documents""")
def csv_messy_round_trip(spark, sf_dir):
    """Whole texts with line breaks, quotes, delimiters and padding, empty texts and NULLs, written and read back."""
    d = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("  "), "text", F.lit(' "quoted, '), "source", F.lit('" ')).alias("body"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), "n_chars")
    path = scratch_path(spark, "csv-messy")
    io.write_csv(d, path)
    back = io.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "body", "lang", "source",
                       F.col("n_chars").cast("bigint").alias("n_chars"))


@register("csv_round_trip", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def csv_round_trip(spark, sf_dir):
    """customer -> CSV part files in the shared scratch folder -> read back as text -> typed."""
    c = I.table(spark, sf_dir, "customer")
    path = scratch_path(spark, "csv-round-trip")
    io.write_csv(c, path)
    back = io.read_csv(spark, path)
    return back.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"),
        fc.clean_amount("c_acctbal").alias("c_acctbal"),
        "c_mktsegment",
    )


# -- streaming -------------------------------------------------------------------------


def _table_stream(spark, sf_dir: str, name: str) -> DataFrame:
    """The table's file(s) as a file stream (schema from the Parquet footer)."""
    base = sf_dir.rstrip("/")
    schema = I.table(spark, sf_dir, name).schema
    # a glob that only the exact name fits: a file stream takes folders and globs, not single files
    return st.file_stream(spark, f"{base}/{name}.parque[t]", schema, fmt="parquet", base_path=base)


@register("stream_running_totals", """
SELECT l_returnflag, l_linestatus, count(*) AS record_count, sum(l_quantity) AS total_amount
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def stream_running_totals(spark, sf_dir):
    """Running totals kept by Structured Streaming, run over every file available now."""
    totals = st.running_totals(_table_stream(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
                               "l_quantity")
    out = scratch_path(spark, "stream-totals")
    st.run_available(totals, out, output_mode="complete")
    return spark.read.parquet(out)


@register("stream_filter", "SELECT * FROM orders WHERE " + ORDER_FILTERS_SQL.format(op="AND"))
def stream_filter(spark, sf_dir):
    """The analyze filter applied to orders as they arrive (append, exactly-once file sink)."""
    kept = st.filter_stream(_table_stream(spark, sf_dir, "orders"), ORDER_FILTERS, "AND")
    out = scratch_path(spark, "stream-filter")
    st.run_available(kept, out, output_mode="append")
    return spark.read.parquet(out)
