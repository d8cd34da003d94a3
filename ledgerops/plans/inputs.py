"""Inputs for the registered queries, derived by Spark from the given tables.

Every builder reads the driver's Parquet tables and derives the ledger-shaped
sources that the tools expect, so the work grows with the tables. The SQL text
next to each builder is the same derivation for DuckDB (used by the oracle).

* ``ledger_a``  orders as source A: ``k, d, amt, memo``
* ``ledger_b``  A with known differences: keys dropped (missing in B), dates
  moved by a day (date note), amounts moved by 5.0 (variance) or 0.004
  (inside the 0.01 tolerance), and new negative keys (missing in A)
* text renderings of lineitem / orders / labels for the cleaning tools
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconciliation import ReconConfig, Roles
from ..session import scratch_path

TOLERANCE = 0.01
LEDGER_CONFIG = ReconConfig("k", a=Roles("d", "amt", "memo"), b=Roles("d", "amt", "memo"), amount_tolerance=TOLERANCE)
SPLIT_YEARS = tuple(range(1995, 2002))


_RELATIONS: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Each table is resolved once per session (file listing and
    Parquet footers) and the relation is reused by every query, as a catalog
    table would be; a DataFrame is an immutable plan, so sharing it is safe."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    cached = _RELATIONS.get((id(spark), path))
    if cached is None or cached[0] is not spark:
        cached = (spark, spark.read.parquet(path))
        _RELATIONS[(id(spark), path)] = cached
    return cached[1]


# -- reconcile sources ---------------------------------------------------------

def ledger_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.col("o_totalprice").alias("amt"),
        F.col("o_orderpriority").alias("memo"),
    )


def ledger_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ledger_a(spark, sf_dir)
    k = F.col("k")
    kept = a.where(k % 17 != 0).select(
        k,
        F.when(k % 11 == 0, F.date_add("d", 1)).otherwise(F.col("d")).alias("d"),
        F.when(k % 7 == 0, F.col("amt") + F.lit(5.0))
        .when(k % 5 == 0, F.col("amt") + F.lit(0.004))
        .otherwise(F.col("amt")).alias("amt"),
        "memo",
    )
    extra = a.where(k % 19 == 0).select((F.lit(-1) - k).alias("k"), "d", "amt", "memo")
    return kept.unionByName(extra)


LEDGERS_SQL = """
ledger_a AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS amt, o_orderpriority AS memo
  FROM orders),
ledger_b AS (
  SELECT k,
         CASE WHEN k % 11 = 0 THEN d + 1 ELSE d END AS d,
         CASE WHEN k % 7 = 0 THEN amt + 5.0 WHEN k % 5 = 0 THEN amt + 0.004 ELSE amt END AS amt,
         memo
  FROM ledger_a WHERE k % 17 <> 0
  UNION ALL
  SELECT -1 - k AS k, d, amt, memo FROM ledger_a WHERE k % 19 = 0)
"""


def _with_gaps(df: DataFrame, key_every: int, date_every: int, amount_every: int) -> DataFrame:
    k = F.col("k")
    return df.select(
        F.when(k % key_every == 0, F.lit(None)).otherwise(k).alias("k"),
        F.when(k % date_every == 0, F.lit(None)).otherwise(F.col("d")).alias("d"),
        F.when(k % amount_every == 0, F.lit(None)).otherwise(F.col("amt")).alias("amt"),
        "memo",
    )


def ledger_a_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A with missing keys, dates and amounts (NULL), as real exports have."""
    return _with_gaps(ledger_a(spark, sf_dir), 23, 29, 31)


def ledger_b_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_gaps(ledger_b(spark, sf_dir), 37, 41, 43)


LEDGERS_GAPS_SQL = LEDGERS_SQL + """,
gaps_a AS (
  SELECT CASE WHEN k % 23 = 0 THEN NULL ELSE k END AS k, CASE WHEN k % 29 = 0 THEN NULL ELSE d END AS d,
         CASE WHEN k % 31 = 0 THEN NULL ELSE amt END AS amt, memo FROM ledger_a),
gaps_b AS (
  SELECT CASE WHEN k % 37 = 0 THEN NULL ELSE k END AS k, CASE WHEN k % 41 = 0 THEN NULL ELSE d END AS d,
         CASE WHEN k % 43 = 0 THEN NULL ELSE amt END AS amt, memo FROM ledger_b)
"""


def money_text(amount: Column) -> Column:
    """``1,234.56`` (via DECIMAL, so no float digits leak into the text)."""
    return F.format_number(amount.cast("decimal(18,2)"), 2)


MONEY_TEXT_SQL = "format('{{:,.2f}}', CAST(CAST({x} AS DECIMAL(18,2)) AS DOUBLE))"


def money_sql(x: str) -> str:
    return MONEY_TEXT_SQL.format(x=x)


def _signed(df: DataFrame) -> DataFrame:
    # Every third key is a credit, shown in parentheses by source A.
    return df.withColumn("amt", F.when(F.col("k") % 3 == 0, -F.col("amt")).otherwise(F.col("amt")))


def ledger_a_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source A as text: ``dd/MM/yyyy`` dates, ``$1,234.56`` / ``($1,234.56)`` amounts."""
    a = _signed(ledger_a(spark, sf_dir))
    amt = F.col("amt")
    text = F.when(amt < 0, F.concat(F.lit("($"), money_text(-amt), F.lit(")"))) \
        .otherwise(F.concat(F.lit("$"), money_text(amt)))
    return a.select("k", F.date_format("d", "dd/MM/yyyy").alias("d"), text.alias("amt"), "memo")


def ledger_b_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B as text: ISO dates, ``R-1,234.56`` amounts."""
    b = _signed(ledger_b(spark, sf_dir))
    return b.select("k", F.col("d").cast("string").alias("d"),
                    F.concat(F.lit("R"), money_text(F.col("amt"))).alias("amt"), "memo")


LEDGERS_TEXT_SQL = LEDGERS_SQL + """,
signed_a AS (SELECT k, d, CASE WHEN k % 3 = 0 THEN -amt ELSE amt END AS amt, memo FROM ledger_a),
signed_b AS (SELECT k, d, CASE WHEN k % 3 = 0 THEN -amt ELSE amt END AS amt, memo FROM ledger_b),
text_a AS (
  SELECT k, strftime(d, '%d/%m/%Y') AS d,
         CASE WHEN amt < 0 THEN '($' || {neg} || ')' ELSE '$' || {pos} END AS amt, memo
  FROM signed_a),
text_b AS (
  SELECT k, CAST(d AS VARCHAR) AS d, 'R' || {b} AS amt, memo FROM signed_b)
""".format(neg=money_sql("-amt"), pos=money_sql("amt"), b=money_sql("amt"))


# -- lineitem at line level (duplicate keys) ------------------------------------

def lines_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("date").alias("d"),
                     F.col("l_extendedprice").alias("amt"), F.col("l_returnflag").alias("memo"))


def lines_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    return li.select(
        F.col("l_orderkey").alias("k"),
        F.when(F.col("l_linenumber") == 1, F.date_add(d, 1)).otherwise(d).alias("d"),
        F.col("l_extendedprice").alias("amt"),
        F.col("l_linestatus").alias("memo"),
    )


LINES_SQL = """
lines_a AS (
  SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS amt, l_returnflag AS memo
  FROM lineitem),
lines_b AS (
  SELECT l_orderkey AS k,
         CASE WHEN l_linenumber = 1 THEN CAST(l_shipdate AS DATE) + 1 ELSE CAST(l_shipdate AS DATE) END AS d,
         l_extendedprice AS amt, l_linestatus AS memo
  FROM lineitem)
"""


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source B for orders-vs-lines: per order, first ship date and exact line total.

    Prices have cents, so the total is summed exactly as whole cents in a long
    (cheaper than a wide DECIMAL sum) and divided once: the same double as the
    exact decimal total.
    """
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.min(F.col("l_shipdate").cast("date")).alias("d"),
        (F.sum(cents) / F.lit(100.0)).alias("amt"),
        F.count(F.lit(1)).cast("string").alias("memo"),
    )


ORDER_TOTALS_SQL = """
order_totals AS (
  SELECT l_orderkey AS k, MIN(CAST(l_shipdate AS DATE)) AS d,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amt,
         CAST(COUNT(*) AS VARCHAR) AS memo
  FROM lineitem GROUP BY l_orderkey)
"""


# -- text tables for the cleaning tools -----------------------------------------

def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem prices written eight ways (currency, parentheses, suffixes, n/a, ...)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    x = F.col("l_extendedprice")
    money = money_text(x)
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    european = F.translate(money, ",.", ".,")
    raw = (
        F.when(kind == 0, F.concat(F.lit("$"), money))
        .when(kind == 1, F.concat(F.lit("("), money, F.lit(")")))
        .when(kind == 2, F.concat(F.lit("R"), x.cast("decimal(18,2)").cast("string")))
        .when(kind == 3, F.concat(F.lit(" ($"), money, F.lit(") ")))
        .when(kind == 4, F.concat(money, F.lit(" CR")))
        .when(kind == 5, F.lit("n/a"))
        .when(kind == 6, F.concat(F.lit("€"), F.translate(money, ",", " ")))
        .otherwise(european)
    )
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"))


AMOUNT_TEXTS_SQL = """
amount_texts AS (
  SELECT l_orderkey, l_linenumber,
    CASE (l_orderkey + l_linenumber) % 8
      WHEN 0 THEN '$' || {m}
      WHEN 1 THEN '(' || {m} || ')'
      WHEN 2 THEN 'R' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 3 THEN ' ($' || {m} || ') '
      WHEN 4 THEN {m} || ' CR'
      WHEN 5 THEN 'n/a'
      WHEN 6 THEN '€' || translate({m}, ',', ' ')
      ELSE translate({m}, ',.', '.,')
    END AS raw
  FROM lineitem)
""".format(m=money_sql("l_extendedprice"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written six ways (ISO, day first, month first, short, words, timestamp)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 6
    raw = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(kind == 2, F.date_format(d, "MM/dd/yyyy"))
        .when(kind == 3, F.date_format(d, "d/M/yyyy"))
        .when(kind == 4, F.date_format(d, "MMM d, yyyy"))
        .otherwise(d.cast("string"))
    )
    return o.select("o_orderkey", raw.alias("raw"))


DATE_TEXTS_SQL = """
date_texts AS (
  SELECT o_orderkey,
    CASE o_orderkey % 6
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN 3 THEN strftime(o_orderdate, '%-d/%-m/%Y')
      WHEN 4 THEN strftime(o_orderdate, '%b %-d, %Y')
      ELSE CAST(o_orderdate AS VARCHAR)
    END AS raw
  FROM orders)
"""


def flag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label flags written five ways (Yes/No, y/n, padded TRUE/false, 1/0, maybe)."""
    lab = table(spark, sf_dir, "labels")
    q = F.col("quality") == 1
    kind = F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, F.when(q, F.lit("Yes")).otherwise(F.lit("No")))
        .when(kind == 1, F.when(q, F.lit("y")).otherwise(F.lit("n")))
        .when(kind == 2, F.when(q, F.lit(" TRUE ")).otherwise(F.lit("false")))
        .when(kind == 3, F.col("quality").cast("string"))
        .otherwise(F.lit("maybe"))
    )
    return lab.select("doc_id", raw.alias("raw"), "toxic")


FLAG_TEXTS_SQL = """
flag_texts AS (
  SELECT doc_id,
    CASE doc_id % 5
      WHEN 0 THEN CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END
      WHEN 1 THEN CASE WHEN quality = 1 THEN 'y' ELSE 'n' END
      WHEN 2 THEN CASE WHEN quality = 1 THEN ' TRUE ' ELSE 'false' END
      WHEN 3 THEN CAST(quality AS VARCHAR)
      ELSE 'maybe'
    END AS raw,
    toxic
  FROM labels)
"""


def mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw export-like table: ``id, trans_date, amount, active, memo`` (all text but id)."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "MM/dd/yyyy")) \
        .otherwise(F.date_format(d, "dd/MM/yyyy"))
    active = F.when(F.col("o_orderstatus") == "F", F.lit("Yes")) \
        .when(F.col("o_orderstatus") == "O", F.lit("n")).otherwise(F.lit("maybe"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        date.alias("trans_date"),
        F.concat(F.lit("$"), money_text(F.col("o_totalprice"))).alias("amount"),
        active.alias("active"),
        F.col("o_orderpriority").alias("memo"),
    )


MIXED_TABLE_SQL = """
mixed AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END
      AS trans_date,
    '$' || {m} AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'n' ELSE 'maybe' END AS active,
    o_orderpriority AS memo
  FROM orders)
""".format(m=money_sql("o_totalprice"))


def lineitem_parts(spark: SparkSession, sf_dir: str) -> list[str]:
    """lineitem written once by ship year, a folder per year, as if each year came in its own file; the
    folders' paths. lineitem is scanned once; each folder holds only its own rows."""
    path = scratch_path(spark, "lineitem-years")
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    kept = F.when(year.between(SPLIT_YEARS[0], SPLIT_YEARS[-1]), year.cast("string")).otherwise(F.lit("other"))
    li.withColumn("part", kept).write.partitionBy("part").parquet(path)
    return sorted({f.rsplit("/", 1)[0] for f in spark.read.parquet(path).inputFiles()})


def mixed_key_sources(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The two ledgers with unlike key types: whole numbers against floating ones, against zero-padded text
    (and texts that are no number), against text with digits behind the point and against decimals of up to 38 digits,
    and dates against timestamps."""
    a, b = ledger_a(spark, sf_dir), ledger_b(spark, sf_dir)
    k = F.col("k")
    padded = F.when(k % 13 == 0, F.concat(F.lit("no "), k.cast("string"))).when(k < 0, k.cast("string")) \
        .otherwise(F.lpad(k.cast("string"), 10, "0"))
    halves = F.concat(k.cast("string"), F.when(F.pmod(k, F.lit(3)) == 0, ".4").when(F.pmod(k, F.lit(3)) == 1, ".5").otherwise(""))
    large = F.concat(k.cast("string"), F.when(F.pmod(k, F.lit(17)) == 0, "0" * 20).otherwise("")).cast("decimal(38,0)")
    day = lambda df: df.groupBy("d").agg(F.min("k").cast("double").alias("amt"))  # noqa: E731 - one row per day
    return {
        "whole and floating": (a, b.withColumn("k", k.cast("double"))),
        "whole and text": (a, b.withColumn("k", padded)),
        "whole and decimal text": (a, b.withColumn("k", halves)),
        "whole and large decimal": (a, b.withColumn("k", large)),
        "date and timestamp": (day(a).select(F.col("d").alias("k"), "d", "amt", F.lit("x").alias("memo")),
                               day(b).select(F.col("d").cast("timestamp_ntz").alias("k"), "d", "amt", F.lit("x").alias("memo"))),
    }


MIXED_KEYS_SQL = LEDGERS_SQL.strip() + """,
float_b AS (SELECT CAST(k AS DOUBLE) AS k, d, amt FROM ledger_b),
text_b AS (
  SELECT TRY_CAST(CASE WHEN k % 13 = 0 THEN 'no ' || k WHEN k < 0 THEN CAST(k AS VARCHAR)
                  ELSE lpad(CAST(k AS VARCHAR), 10, '0') END AS BIGINT) AS k, d, amt FROM ledger_b),
halves_b AS (
  SELECT CAST(k || CASE ((k % 3) + 3) % 3 WHEN 0 THEN '.4' WHEN 1 THEN '.5' ELSE '' END AS BIGINT) AS k, d, amt FROM ledger_b),
large_b AS (
  SELECT CAST(k || CASE WHEN k % 17 = 0 THEN '00000000000000000000' ELSE '' END AS DECIMAL(38,0)) AS k, d, amt FROM ledger_b),
day_a AS (SELECT d AS k, d, CAST(min(k) AS DOUBLE) AS amt FROM ledger_a GROUP BY d),
day_b AS (SELECT CAST(d AS TIMESTAMP) AS k, d, CAST(min(k) AS DOUBLE) AS amt FROM ledger_b GROUP BY d)
"""
