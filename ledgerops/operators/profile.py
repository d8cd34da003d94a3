"""Column profiles and match-key candidates.

The role/type guess itself is name-only (patterns below). The profile adds
what only the data can tell, computed by Spark in one pass over the table:
per column the non-NULL count and the share of non-NULL values that the amount,
date and boolean cleaners can parse. Key candidates get NULL counts, distinct
counts on both sides and how many distinct keys of A occur in B.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import clean_amount, clean_boolean, clean_date, parse_date
from ..functions.names import column, resolve
from ..sources.inspect import sql_type_name
from .reconciliation import comparable

# Lower-case name fragments that suggest a column's role.
# General tools (clean, aggregate, analyze):
DATE_PATTERNS = ("date", "dt", "trans_date", "posting", "created", "updated")
AMOUNT_PATTERNS = ("amount", "amt", "value", "total", "sum", "price", "cost")
DESCRIPTION_PATTERNS = ("description", "desc", "narration", "memo", "reference", "note")
# Reconcile tool:
RECON_DATE_PATTERNS = ("date", "dt", "trans_date", "posting")
RECON_AMOUNT_PATTERNS = ("amount", "amt", "value", "total", "sum")
RECON_DESCRIPTION_PATTERNS = ("description", "desc", "narration", "memo", "reference")

ROLE_PATTERNS = {"date": DATE_PATTERNS, "amount": AMOUNT_PATTERNS, "description": DESCRIPTION_PATTERNS}
RECON_ROLE_PATTERNS = {
    "date": RECON_DATE_PATTERNS,
    "amount": RECON_AMOUNT_PATTERNS,
    "description": RECON_DESCRIPTION_PATTERNS,
}


def _matches(name: str, patterns: tuple[str, ...]) -> bool:
    lower = name.lower()
    return any(p.lower() in lower for p in patterns)


def detect_column(columns: list[str], patterns: tuple[str, ...]) -> str | None:
    """First column (in column order) whose lower-case name contains a pattern."""
    for name in columns:
        if _matches(name, patterns):
            return name
    return None


def detect_roles(columns: list[str], patterns: dict[str, tuple[str, ...]] = RECON_ROLE_PATTERNS) -> dict:
    """Date, amount and description column; fall back to column 0, column 1, none."""
    date = detect_column(columns, patterns["date"])
    amount = detect_column(columns, patterns["amount"])
    desc = detect_column(columns, patterns["description"])
    return {
        "date": date or (columns[0] if columns else None),
        "amount": amount or (columns[1] if len(columns) > 1 else None),
        "description": desc,
    }


def name_role(name: str, patterns: dict[str, tuple[str, ...]] = ROLE_PATTERNS) -> str | None:
    for role in ("date", "amount", "description"):
        if _matches(name, patterns[role]):
            return role
    return None


def guess_type(name: str, data_type: T.DataType) -> str:
    """Date pattern -> Date, amount pattern -> Number, else by storage type, else Text."""
    if _matches(name, DATE_PATTERNS):
        return "Date"
    if _matches(name, AMOUNT_PATTERNS):
        return "Number"
    if isinstance(data_type, T.NumericType):
        return "Number"
    if isinstance(data_type, T.BooleanType):
        return "Boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "Date"
    return "Text"


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _q(name: str) -> Column:
    return column(name)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole).cast("double"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, SQL type, rows, non_null,
    number_share, date_share, bool_share, name_role, guessed_type.

    A single aggregation job (partial aggregates per task, one final row);
    the per-column rows are produced by exploding that one row.
    """
    fields = df.schema.fields
    # The cleaned date text is projected once per column, so the date parser
    # reads a plain value instead of re-running the cleaner at every reference.
    staged = df.select(*[_q(f.name).alias(f"_v{i}") for i, f in enumerate(fields)],
                       *[clean_date(_q(f.name)).alias(f"_cd{i}") for i, f in enumerate(fields)])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"_v{i}")
        aggs += [
            F.count(c).alias(f"_nn{i}"),
            F.count(clean_amount(c, f.dataType)).alias(f"_num{i}"),
            F.count(parse_date(c, f.dataType) if _is_time(f.dataType) else parse_date(F.col(f"_cd{i}"))).alias(f"_date{i}"),
            F.count(clean_boolean(c)).alias(f"_bool{i}"),
        ]
    one_row = staged.agg(*aggs)
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(sql_type_name(f.dataType)).alias("type"),
            F.col(f"_nn{i}").alias("non_null"),
            F.col(f"_num{i}").alias("_num"),
            F.col(f"_date{i}").alias("_date"),
            F.col(f"_bool{i}").alias("_bool"),
            F.lit(name_role(f.name)).cast("string").alias("name_role"),
            F.lit(guess_type(f.name, f.dataType)).alias("guessed_type"),
        )
        for i, f in enumerate(fields)
    ]
    exploded = one_row.select(F.col("_rows").alias("rows"), F.explode(F.array(*entries)).alias("e"))
    return exploded.select(
        "e.position", "e.column", "e.type", "rows", "e.non_null",
        _share("e._num", "e.non_null").alias("number_share"),
        _share("e._date", "e.non_null").alias("date_share"),
        _share("e._bool", "e.non_null").alias("bool_share"),
        "e.name_role", "e.guessed_type",
    )


def _value_counts(df: DataFrame, values: list[Column]) -> DataFrame:
    """``(position, is_null, v, rows)`` per distinct value of each candidate column, in one pass.

    The candidate columns are unpivoted (as text of a type that both sides of a
    candidate share, so text equality is value equality) and counted with
    map-side partial aggregation. NULL is its own grouping key (``is_null``) and
    never a NULL value, so joins on these keys infer no filters and reuse this
    aggregation's partitioning.
    """
    entries = [F.struct(F.lit(pos).alias("position"), value.cast("string").alias("v")) for pos, value in enumerate(values)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select(
        F.col("e.position").alias("position"),
        F.col("e.v").isNull().alias("is_null"),
        F.coalesce(F.col("e.v"), F.lit("")).alias("v"),
    )
    return long.groupBy("position", "is_null", "v").agg(F.count(F.lit(1)).alias("rows"))


def key_candidates(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns present in both A and B (in A's order) with evidence for choosing a key:
    ``a_nulls, a_distinct, b_nulls, b_distinct, a_keys_in_b, a_key_share``.

    Unlike types are compared as the reconcile tool compares keys (see
    ``reconciliation.comparable``); a value that the common type cannot hold
    counts as NULL. ``columns`` leaves out columns that no key can be (floating
    amounts, long texts), whose every value would be shuffled.

    One scan and one shuffle per side: the value counts of each side feed
    both its metrics and the match with the other side's value counts (same
    partitioning, no further shuffle; ``ReusedExchange`` in the executed
    plan). Every metric is a conditional aggregate, so no filter splits the
    plan into separate scans.
    """
    wanted = a.columns if columns is None else [c for c in a.columns if c.lower() in {n.lower() for n in columns}]
    pairs = [(c, other) for c in wanted if (other := resolve(b.columns, c)) is not None]
    if not pairs:
        raise ValueError("sources A and B have no column name in common")
    common = [c for c, _ in pairs]
    values = [comparable(_q(x), a.schema[x].dataType, _q(y), b.schema[y].dataType) for x, y in pairs]
    counts_a = _value_counts(a, [x for x, _ in values])
    counts_b = _value_counts(b, [y for _, y in values])
    zero = F.lit(0).cast("long")
    not_null = ~F.col("is_null")

    def side_metrics(counts: DataFrame, side: str) -> DataFrame:
        return counts.groupBy("position").agg(
            F.coalesce(F.sum(F.when(F.col("is_null"), F.col("rows"))), zero).alias(f"{side}_nulls"),
            F.count_if(not_null).cast("long").alias(f"{side}_distinct"),
            zero.alias(f"{other[side]}_nulls"), zero.alias(f"{other[side]}_distinct"),
            zero.alias("a_keys_in_b"),
        )

    other = {"a": "b", "b": "a"}
    # Values are unique per side, so an inner join is the semi-join; it reads
    # both sides' full value counts, which keeps them identical to the ones
    # the metrics use (column pruning would otherwise make two plans of each).
    matched = counts_a.join(counts_b.withColumnRenamed("rows", "rows_b"), ["position", "is_null", "v"], "inner")
    in_b = matched.groupBy("position").agg(
        zero.alias("a_nulls"), zero.alias("a_distinct"), zero.alias("b_nulls"), zero.alias("b_distinct"),
        F.count_if(not_null & (F.col("rows") > 0) & (F.col("rows_b") > 0)).cast("long").alias("a_keys_in_b"),
    )
    stacked = side_metrics(counts_a, "a").unionByName(side_metrics(counts_b, "b"), allowMissingColumns=False) \
        .unionByName(in_b)
    names = F.array(*[F.lit(n) for n in common])
    wide = stacked.groupBy("position").agg(*[F.sum(c).alias(c) for c in
                                              ("a_nulls", "a_distinct", "b_nulls", "b_distinct", "a_keys_in_b")])
    return wide.select(
        "position", F.element_at(names, F.col("position") + 1).alias("column"),
        "a_nulls", "a_distinct", "b_nulls", "b_distinct", "a_keys_in_b",
        F.when(F.col("a_distinct") > 0, F.col("a_keys_in_b") / F.col("a_distinct")).alias("a_key_share"),
    )
