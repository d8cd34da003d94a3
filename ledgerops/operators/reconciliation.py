"""Reconcile two sources on one key with an absolute amount tolerance.

Five result sets, as the ledger tools define them:

* exact matches          key equal, dates equal, |amount_a - amount_b| <= tolerance
* matches with date note key equal, dates differ, amounts within tolerance
* amount variances       key equal, amounts differ by more than the tolerance
* missing in B           rows of A whose key has no row in B (all A columns)
* missing in A           rows of B whose key has no row in A (all B columns)

Duplicate keys give every pair (plain equi-join). A pair with a NULL amount,
or a NULL date and amounts inside the tolerance, belongs to none of the five
sets; it is counted as ``unclassified`` in the summary. NULL keys never match.

Plan shape (Spark-first instead of five separate statements):

* the three matched sets share one inner join and one CASE (``category``);
  Spark shuffles both sides by key, AQE splits a hot key's partition on either
  side and replicates the other side's piece (no hand-made salting needed);
* the missing sets are anti-joins against the *distinct* keys of the other
  side, so the right side of the anti-join is deduplicated map-side and a hot
  key there is one row; both sides are shuffled, whatever the keys' estimated size;
* rows with a NULL key skip the anti-join (they are missing by definition), so
  they never meet in one partition;
* the summary counts pairs without forming them: both sides are stacked and
  reduced once to ``(key, date, amount) -> rows of A, rows of B``; sizes, missing
  rows and the number of pairs are sums and products by key, and *near* pairs
  (amounts within the tolerance) are differences of running totals over the sorted
  amounts, in one task for a key of moderate size and in range partitions that cut a
  hot key by its amounts. Variances and unclassified pairs follow by subtraction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import NUMBER_TEXT, amount_parts, clean_date, parse_amount, parse_date, safe_double
from ..functions.names import column, resolve
from .nearness import near_counts, reach_of
from .totals import exact_totals

# Category names, the note text and the export file names.
EXACT_MATCH = "exact_match"
MATCH_WITH_DATE_NOTE = "match_with_date_note"
AMOUNT_VARIANCE = "amount_variance"
MISSING_IN_B = "missing_in_b"
MISSING_IN_A = "missing_in_a"
CATEGORIES = (EXACT_MATCH, MATCH_WITH_DATE_NOTE, AMOUNT_VARIANCE, MISSING_IN_B, MISSING_IN_A)
DATE_NOTE_TEXT = "Date mismatch"
RESULT_FILE_NAMES = {
    "exact_matches": "exact_matches.csv",
    "matches_with_date_note": "matches_with_date_note.csv",
    "amount_variances": "amount_variances.csv",
    "missing_in_b": "missing_in_source_b.csv",
    "missing_in_a": "missing_in_source_a.csv",
}

PAIR_COLUMNS = ("match_key", "date_a", "date_b", "amount_a", "amount_b", "description_a", "description_b")
_KEY = {"A": "_key_a", "B": "_key_b"}


@dataclass(frozen=True)
class Roles:
    """Which columns of one source hold the date, the amount and (optionally) the description."""

    date: str = "date"
    amount: str = "amount"
    description: str | None = None


@dataclass(frozen=True)
class ReconConfig:
    """The key that both sources share, the roles of each source's columns, and the absolute tolerance."""

    match_key: str
    a: Roles = Roles()
    b: Roles = Roles()
    amount_tolerance: float = 0.0

    def __post_init__(self) -> None:
        if not math.isfinite(self.amount_tolerance):
            raise ValueError("the tolerance must be a finite number")


def category(amount_a: Column, amount_b: Column, date_a: Column, date_b: Column, tolerance: float) -> Column:
    """Classify one matched pair; NULL when no rule applies (unclassified).

    ``delta <= tolerance`` is repeated in the last two branches so that a NULL
    amount never falls through to a match.
    """
    delta = F.abs(amount_a - amount_b)
    tol = F.lit(float(tolerance))
    return (
        F.when(delta > tol, F.lit(AMOUNT_VARIANCE))
        .when((delta <= tol) & (date_a == date_b), F.lit(EXACT_MATCH))
        .when((delta <= tol) & (date_a != date_b), F.lit(MATCH_WITH_DATE_NOTE))
    )


def _found(df: DataFrame, name: str, side: str) -> str:
    found = resolve(df.columns, name)
    if found is None:
        raise ValueError(f"column {name!r} not found in source {side}: {df.columns}")
    return found


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _digits(kind: T.DataType) -> tuple[int, int]:
    """Digits before and behind the point of a whole or decimal type."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return {"tinyint": 3, "smallint": 5, "int": 10}.get(kind.simpleString(), 19), 0


def comparable(a: Column, type_a: T.DataType, b: Column, type_b: T.DataType) -> tuple[Column, Column]:
    """Both sides of an equality in one type, as the ledger SQL compares them.

    Numbers meet in their common numeric type (whole numbers and decimals
    exactly, DOUBLE if either side is floating). Text against a number is read in
    that number's own type, rounded half away from zero (``'01'`` equals 1,
    ``'1.5'`` equals 2 but not the DECIMAL 2.0), text against a date as a date;
    text that is neither, or out of the type's range, equals nothing. A date
    against a timestamp counts as its midnight. Any other pair of types is
    compared as text."""
    text = T.StringType()
    if type_a == type_b:
        return a, b
    if isinstance(type_a, T.NumericType) and isinstance(type_b, T.NumericType):
        floating = isinstance(type_a, (T.FloatType, T.DoubleType)) or isinstance(type_b, (T.FloatType, T.DoubleType))
        if floating:
            return a.cast("double"), b.cast("double")
        if isinstance(type_a, T.IntegralType) and isinstance(type_b, T.IntegralType):
            return a.cast("bigint"), b.cast("bigint")
        (digits_a, scale_a), (digits_b, scale_b) = _digits(type_a), _digits(type_b)
        scale = max(scale_a, scale_b)
        # the side with this scale always fits; a value of the other one that does not has no equal there
        common = T.DecimalType(min(38, max(digits_a, digits_b) + scale), scale)
        return a.try_cast(common), b.try_cast(common)
    if type_b == text and type_a != text:
        right, left = comparable(b, type_b, a, type_a)
        return left, right
    if type_a == text and isinstance(type_b, (T.FloatType, T.DoubleType)):
        return safe_double(a), b.cast("double")
    if type_a == text and isinstance(type_b, T.IntegralType):
        whole = F.when(a.rlike(NUMBER_TEXT), F.trim(a).try_cast(T.DecimalType(38, 0)))
        return whole.try_cast(type_b), b
    if type_a == text and isinstance(type_b, T.DecimalType):
        return F.when(a.rlike(NUMBER_TEXT), F.trim(a).try_cast(type_b)), b
    if type_a == text and isinstance(type_b, T.DateType):
        return parse_date(a), b
    if type_a == text and _is_time(type_b):
        return a.try_cast(type_b), b
    if _is_time(type_a) and _is_time(type_b):
        kind = T.TimestampNTZType()
        return a.cast(kind), b.cast(kind)
    return a.cast(text), b.cast(text)


def exact_from(pairs: DataFrame) -> DataFrame:
    """Exact matches out of classified pairs (seven columns)."""
    return pairs.where(F.col("category") == EXACT_MATCH).select(*PAIR_COLUMNS)


def date_note_from(pairs: DataFrame) -> DataFrame:
    """Matches with a date note: seven columns plus ``note`` last."""
    return (pairs.where(F.col("category") == MATCH_WITH_DATE_NOTE)
            .select(*PAIR_COLUMNS, F.lit(DATE_NOTE_TEXT).alias("note")))


def variance_from(pairs: DataFrame) -> DataFrame:
    """Amount variances: ``variance`` comes before the descriptions."""
    return pairs.where(F.col("category") == AMOUNT_VARIANCE).select(
        "match_key", "date_a", "date_b", "amount_a", "amount_b", "variance",
        "description_a", "description_b",
    )


class Reconciliation:
    """Lazy result of ``reconcile``: every attribute is a DataFrame (no job runs here)."""

    def __init__(self, a: DataFrame, b: DataFrame, config: ReconConfig):
        if a is None or b is None:
            raise ValueError("both sources must be given before reconciliation")
        self.a, self.b, self.config = a, b, config
        self._roles = {}
        for df, side, roles in ((a, "A", config.a), (b, "B", config.b)):
            found = Roles(_found(df, roles.date, side), _found(df, roles.amount, side),
                          _found(df, roles.description, side) if roles.description else None)
            kind = df.schema[found.amount].dataType
            if not isinstance(kind, T.NumericType):
                raise TypeError(f"amount column {found.amount!r} of source {side} is {kind.simpleString()}; "
                                "clean it to a number first (clean_amount)")
            self._roles[side] = found
        name_a, name_b = _found(a, config.match_key, "A"), _found(b, config.match_key, "B")
        self._match_key = column(name_a)
        self._key_a, self._key_b = comparable(column(name_a), a.schema[name_a].dataType,
                                              column(name_b), b.schema[name_b].dataType)

    # -- role projection -------------------------------------------------
    def _side(self, side: str) -> DataFrame:
        df, key = (self.a, self._key_a) if side == "A" else (self.b, self._key_b)
        roles, suffix = self._roles[side], side.lower()
        description = column(roles.description) if roles.description else F.lit(None).cast("string")
        return df.select(
            *([self._match_key.alias("match_key")] if side == "A" else []),
            key.alias(_KEY[side]),
            column(roles.date).alias(f"date_{suffix}"),
            column(roles.amount).alias(f"amount_{suffix}"),
            description.alias(f"description_{suffix}"),
        )

    # -- matched pairs (one join for three result sets) -------------------
    @cached_property
    def pairs(self) -> DataFrame:
        """All key-matched pairs with ``variance`` and ``category`` (NULL = unclassified)."""
        joined = self._side("A").join(self._side("B"), F.col(_KEY["A"]) == F.col(_KEY["B"]), "inner")
        cat = category(F.col("amount_a"), F.col("amount_b"), F.col("date_a"), F.col("date_b"),
                       self.config.amount_tolerance)
        return joined.select(
            "match_key", "date_a", "date_b", "amount_a", "amount_b",
            F.abs(F.col("amount_a") - F.col("amount_b")).alias("variance"),
            "description_a", "description_b",
            cat.alias("category"),
        )

    @property
    def exact_matches(self) -> DataFrame:
        return exact_from(self.pairs)

    @property
    def matches_with_date_note(self) -> DataFrame:
        return date_note_from(self.pairs)

    @property
    def amount_variances(self) -> DataFrame:
        return variance_from(self.pairs)

    @property
    def unclassified(self) -> DataFrame:
        return self.pairs.where(F.col("category").isNull()).select(*PAIR_COLUMNS)

    # -- one-sided rows --------------------------------------------------
    @staticmethod
    def _missing(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
        keys = other.select(other_key.alias("_other_key")).where(F.col("_other_key").isNotNull()).distinct()
        # Both sides are always dealt out by key, and each task holds its own share of the distinct keys. The keys of a
        # compressed file are estimated small: a broadcast would hold all keys of the other source in every executor.
        # A source that is a union is joined as one: Spark would push the join into each of its branches, hold the keys once
        # for each, and deal a small branch, whose few bytes ask for few partitions, against all keys in a task or two. A
        # condition that is not deterministic (and always true) stays above the union, and the join above it.
        rows = df.where(key.isNotNull()).where(F.monotonically_increasing_id() >= 0)
        keyed = rows.join(keys.hint("shuffle_hash"), key == F.col("_other_key"), "left_anti")
        return keyed.unionAll(df.where(key.isNull()))

    @property
    def missing_in_b(self) -> DataFrame:
        """Rows of A (all columns, A's order) whose key is absent from B."""
        return self._missing(self.a, self._key_a, self.b, self._key_b)

    @property
    def missing_in_a(self) -> DataFrame:
        """Rows of B (all columns, B's order) whose key is absent from A."""
        return self._missing(self.b, self._key_b, self.a, self._key_a)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "exact_matches": self.exact_matches,
            "matches_with_date_note": self.matches_with_date_note,
            "amount_variances": self.amount_variances,
            "missing_in_b": self.missing_in_b,
            "missing_in_a": self.missing_in_a,
        }

    # -- source totals ---------------------------------------------------
    def source_totals(self) -> DataFrame:
        """Sums of both amount columns (see the module function ``source_totals``)."""
        return source_totals(self.a, self.b, self.config)

    # -- summary ---------------------------------------------------------
    def _stacked(self) -> DataFrame:
        """Both sides as (k, d, amt, n_a, n_b), reduced to one row per distinct (key, date, amount)."""
        roles_a, roles_b = self._roles["A"], self._roles["B"]
        dates = comparable(column(roles_a.date), self.a.schema[roles_a.date].dataType,
                           column(roles_b.date), self.b.schema[roles_b.date].dataType)
        amounts = comparable(column(roles_a.amount), self.a.schema[roles_a.amount].dataType,
                             column(roles_b.amount), self.b.schema[roles_b.amount].dataType)
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        rows = [df.select(key.alias("k"), d.alias("d"), x.alias("amt"), in_a.alias("in_a"), in_b.alias("in_b"))
                for df, key, d, x, in_a, in_b in ((self.a, self._key_a, dates[0], amounts[0], one, none),
                                                  (self.b, self._key_b, dates[1], amounts[1], none, one))]
        reduced = rows[0].unionByName(rows[1]).groupBy("k", "d", "amt").agg(
            F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"))
        # Named through the counts, so that conditions on key and amount stay above the reduction: it is computed
        # once for both of its uses, and a cleaner below it is not repeated inside a pushed-down condition.
        there = F.col("n_a") + F.col("n_b") > 0
        return reduced.select(F.when(there, F.col("k")).alias("k"), "d", F.when(there, F.col("amt")).alias("amt"), "n_a", "n_b")

    def summary(self) -> DataFrame:
        """One row: the five counts, totals, unclassified pairs and source sizes.

        Pairs are counted, not formed: per key as products of row counts, and pairs
        within the tolerance by running totals over the sorted amounts (see
        ``nearness``). The rest of the pairs with both amounts are variances."""
        reduced = self._stacked()
        kind = reduced.schema["amt"].dataType
        keys = near_counts(reduced, reach_of(float(self.config.amount_tolerance), kind))
        zero = F.lit(0).cast("long")
        of_key, of_date = ~F.col("of_date"), F.col("of_date")
        both = F.col("k").isNotNull() & (F.col("rows_a") > 0) & (F.col("rows_b") > 0)
        matched = of_key & both

        def total(value: Column, condition: Column, name: str) -> Column:
            return F.coalesce(F.sum(F.when(condition, value)), zero).alias(name)

        near = of_key & F.col("k").isNotNull()
        sums = keys.agg(
            total(F.col("rows_a"), of_key, "rows_a"), total(F.col("rows_b"), of_key, "rows_b"),
            total(F.col("rows_a"), of_key & ~both, "missing_in_b"), total(F.col("rows_b"), of_key & ~both, "missing_in_a"),
            total(F.col("rows_a") * F.col("rows_b"), matched, "pairs"),
            total(F.col("known_a") * F.col("known_b"), matched, "amount_pairs"),
            total(F.col("near"), near, "near"), total(F.col("near_dated"), near, "near_dated"),
            total(F.col("near"), of_date & F.col("k").isNotNull(), "exact"))
        variance = F.col("amount_pairs") - F.col("near")
        return sums.select(
            F.col("exact").alias("exact_matches"), (F.col("near_dated") - F.col("exact")).alias("matches_with_date_note"),
            variance.alias("amount_variances"), "missing_in_b", "missing_in_a",
            F.col("near_dated").alias("total_matched"),
            (variance + F.col("missing_in_b") + F.col("missing_in_a")).alias("total_unmatched"),
            (F.col("pairs") - F.col("near_dated") - variance).alias("unclassified"), "rows_a", "rows_b",
        )


def source_totals(a: DataFrame, b: DataFrame, config: ReconConfig) -> DataFrame:
    """One row: ``total_a`` and ``total_b``, the sums of both amount columns.

    Works on raw sources too: amount text that does not parse as a number
    counts as NULL. Both sources are summed in one aggregation over their
    union (partial sums per task, one final row), exactly and rounded once.
    """
    name_a, name_b = _found(a, config.a.amount, "A"), _found(b, config.b.amount, "B")
    amount_a = safe_double(column(name_a), a.schema[name_a].dataType)
    amount_b = safe_double(column(name_b), b.schema[name_b].dataType)
    both = a.select(F.lit("a").alias("side"), amount_a.alias("amt")) \
        .unionByName(b.select(F.lit("b").alias("side"), amount_b.alias("amt")))
    return exact_totals(both, [], {f"total_{side}": F.when(F.col("side") == side, F.col("amt")) for side in ("a", "b")})


def reconcile(a: DataFrame, b: DataFrame, config: ReconConfig) -> Reconciliation:
    """Plan a reconciliation of ``a`` against ``b`` (lazy)."""
    return Reconciliation(a, b, config)


def clean_sources(a: DataFrame, b: DataFrame, config: ReconConfig,
                  clean_dates: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clean the amount columns (and date columns) of both sources in place.

    Column order is kept; the cleaned column replaces the original one.
    """
    def prepare(df: DataFrame, roles: Roles, side: str) -> DataFrame:
        amount, date = _found(df, roles.amount, side), resolve(df.columns, roles.date)
        cleaned = {date: clean_date(date)} if clean_dates and date is not None else {}
        if isinstance(df.schema[amount].dataType, T.NumericType):
            return df.withColumns(cleaned) if cleaned else df
        # the digits in a projection of their own: the parser names them many times
        kept, sign = amount_parts(amount)
        return (df.withColumns({**cleaned, "_amount_kept": kept, "_amount_sign": sign})
                .withColumns({amount: parse_amount("_amount_kept", "_amount_sign")}).drop("_amount_kept", "_amount_sign"))

    return prepare(a, config.a, "A"), prepare(b, config.b, "B")


def reconcile_sources(a: DataFrame, b: DataFrame, config: ReconConfig,
                      auto_clean: bool = True) -> Reconciliation:
    """The full reconcile tool: clean amounts and dates (optional), then reconcile."""
    if auto_clean:
        a, b = clean_sources(a, b, config)
    return reconcile(a, b, config)
