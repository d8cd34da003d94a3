"""Counting pairs of amounts within a tolerance without forming them.

``abs(a - b) <= tolerance`` holds for a contiguous range of amounts ``a`` around
each ``b``, so the number of pairs is a difference of two running totals: rows of A
up to the upper end of the range, less those below the lower end. Every row of A is
an event that adds to the running total of its group, every row of B two events
that read it.

Rows are dealt out by key, and their events are made, sorted and counted in the task
where the key's rows are; only the rows go to disk. Keys whose bucket (by hash) has
too many rows for a task go another way: their events are sorted by group and amount
into range partitions, so a group of any size is cut by amount into as many tasks as
it needs; totals run within a partition, and what lies in earlier partitions of the
same group is carried by one small row per group and partition.

The ends of a range are exact: a difference of two doubles is rounded before it is
compared, so it passes if its true value is at most half a unit in the last place
above the tolerance. ``b`` plus that bound is kept as an unevaluated sum of doubles,
whose leading part and the sign of the rest decide every comparison.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where an event stands among events of the same amount: before the rows, a row, behind the rows.
BEFORE, ROW, BEHIND = 0, 1, 2
# The place is held in steps of STEP, with flags of the row below it.
STEP, DATED, KNOWN = 4, 2, 1
# A sort's share of a source's estimated (compressed) bytes: its events take some hundred times as much memory.
SHARE_BYTES = 512 << 10
# The same for rows whose events are made after the shuffle, some 30 MB of them a share.
ROWS_SHARE_BYTES = 1 << 20
MOST_SHARES = 4000
LEAST_SHARES = 8
# Keys are counted by buckets, some a share: a bucket of more rows (of up to six events each) is full, too much for one task.
BUCKETS = 8
MOST_ROWS = 50_000
SUMS = ("rows_a", "rows_b", "known_a", "known_b", "near", "near_dated")
UNKNOWN_BYTES = 1 << 50  # an estimate beyond it stands for an unknown size, as rows from Python have


@dataclass(frozen=True)
class Reach:
    """The largest true difference that still counts as within the tolerance.

    ``exact``: a decimal step for whole numbers and decimals. Otherwise the bound is
    ``main + rest`` and belongs to the range itself only if ``closed``."""

    kind: T.DataType
    main: float = 0.0
    rest: float = 0.0
    closed: bool = True
    exact: Fraction | None = None


def reach_of(tolerance: float, kind: T.DataType) -> Reach | None:
    """The reach of a tolerance for amounts of type ``kind``; None if no pair can be within it."""
    if tolerance < 0:
        return None
    if isinstance(kind, T.DoubleType):
        bits = struct.unpack("<q", struct.pack("<d", tolerance))[0]
        rest = math.ulp(tolerance) / 2 if tolerance else 0.0  # 0 among the smallest doubles, whose differences are exact
        return Reach(T.DoubleType(), tolerance, rest, bits % 2 == 0 or rest == 0)
    if isinstance(kind, T.FloatType):
        bits = struct.unpack("<i", struct.pack("<f", min(tolerance, 3.4028234663852886e38)))[0]
        if _float32(bits) > tolerance:
            bits -= 1  # the largest 32-bit value not above the tolerance
        return Reach(T.DoubleType(), _float32(bits), (_float32(bits + 1) - _float32(bits)) / 2 if bits else 0.0, bits % 2 == 0)
    digits, scale = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
    # the difference is exact and then compared as a double
    bits = struct.unpack("<q", struct.pack("<d", tolerance))[0]
    bound = (Fraction(tolerance) + Fraction(math.ulp(tolerance)) / 2 if tolerance else Fraction(0)) * 10**scale
    steps = math.floor(bound)
    if steps == bound and tolerance and bits % 2:
        steps -= 1
    return Reach(T.DecimalType(min(digits + 1, 38), scale), exact=Fraction(min(steps, 10**digits - 1), 10**scale))


def _float32(bits: int) -> float:
    return struct.unpack("<f", struct.pack("<i", bits))[0] if bits < 0x7F800000 else math.ldexp(1.0, 128)


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """a + b rounded, and the rounding error, exactly."""
    s = a + b
    part = s - a
    return s, (a - (s - part)) + (b - part)


def _upper(x: Column, reach: Reach) -> tuple[Column, Column]:
    """(amount, place) of the upper end of the range around ``x``."""
    if reach.exact is not None:
        end = F.try_add(x, F.lit(_decimal_text(reach.exact, reach.kind.scale)).cast(reach.kind)).try_cast(reach.kind)
        return F.coalesce(end, _largest(reach.kind)), F.lit(BEHIND)
    high, low = _two_sum(x, F.lit(reach.main))
    t, u = _two_sum(low, F.lit(reach.rest))
    end, q = _two_sum(high, t)
    rest = q + u
    beyond = F.abs(high) == float("inf")
    inside = beyond | (rest > 0) | ((rest == 0) & F.lit(reach.closed))
    return F.when(beyond, high).otherwise(end), F.when(inside, BEHIND).otherwise(BEFORE)


def _lower(x: Column, reach: Reach) -> tuple[Column, Column]:
    """(amount, place) of the lower end: that of the upper end around ``-x``, mirrored."""
    end, place = _upper(-x, reach)
    return -end, F.lit(2) - place


def _decimal_text(value: Fraction, scale: int) -> str:
    digits = f"{int(value * 10**scale):0{scale + 1}d}"
    return f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits


def _largest(kind: T.DecimalType) -> Column:
    return F.lit("9" * (kind.precision - kind.scale) + ("." + "9" * kind.scale if kind.scale else "")).cast(kind)


def near_counts(rows: DataFrame, reach: Reach | None) -> DataFrame:
    """(k, of_date, rows_a, rows_b, known_a, known_b, near, near_dated): a row per key, and one (of_date) per key and date.

    ``rows`` has (k, d, amt, n_a, n_b), distinct by (k, d, amt): the number of rows of
    A and of B. rows_* count all rows of a key, known_* those with an amount. near
    counts the pairs of the key, or of the key and date, whose amounts are within the
    tolerance, near_dated those among them with both dates; each pair weighs
    n_a * n_b. Amounts that are NaN or infinite are near nothing. Rows of the NULL
    key are near nothing either and are only counted, in any number of rows (k NULL).
    Rows of a key and date count only in near and near_dated."""
    # One shuffle of the rows themselves, several times fewer than their events: a key's rows meet in one task, those of a
    # full bucket of keys are dealt out evenly. Dealt by a whole number: grouping by a floating key would shuffle again.
    # The number itself is not shuffled but computed again.
    row_shares, shares = _shares(rows)
    buckets = BUCKETS * (row_shares or LEAST_SHARES)
    evenly = F.pmod(F.xxhash64("d", "amt"), F.lit(buckets)).cast("int")
    bucket = F.when(F.col("k").isNull(), evenly).otherwise(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
    slot = F.when(F.col("full"), evenly).otherwise(bucket)
    marked = rows.withColumn("full", _full(rows, bucket, buckets))
    dealt = marked.repartition(row_shares, slot) if row_shares else marked.repartition(slot)
    # not deterministic (and always true), so that the conditions on full stay above the shuffle, which both read
    dealt = dealt.where(F.monotonically_increasing_id() >= 0).withColumn("slot", slot)
    whole, cut = dealt.where(~F.col("full")), dealt.where("full")
    found = [_in_one_task(whole, reach), _cut_by_amount(cut, reach, shares)]
    named = [f.select("k", F.col("day").isNotNull().alias("of_date"), *SUMS) for f in found]
    return named[0].unionAll(named[1])


def _full(rows: DataFrame, bucket: Column, buckets: int) -> Column:
    """Whether a row's bucket has more than MOST_ROWS rows (all are counted; a task sends a number for each bucket)."""
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.agg(F.collect_list(F.when(F.col("n") > MOST_ROWS, F.col("bucket"))).alias("full"))
    # an array by bucket, NULL if none is full
    numbers = F.sequence(F.lit(0), F.lit(buckets - 1))
    by_bucket = full.select(F.when(F.size("full") > 0, F.transform(numbers, lambda i: F.array_contains(F.col("full"), i))))
    return F.coalesce(F.get(by_bucket.scalar(), bucket), F.lit(False))


def _base(rows: DataFrame, reach: Reach | None, *more: str) -> DataFrame:
    amount = F.col("amt").cast(T.DoubleType() if reach is None else reach.kind)
    finite = F.col("amt").isNotNull() & (F.abs(F.col("amt").cast("double")) < float("inf")) & F.lit(reach is not None)
    return rows.select("k", "d", F.when(finite, amount).alias("x"), F.col("amt").isNotNull().alias("known"), "n_a", "n_b", *more)


def _counted(events: DataFrame, *group: str) -> DataFrame:
    """Per group of events: the sums of its rows, and near and near_dated from running totals of the group alone."""
    until = Window.partitionBy(*group).orderBy("x", "place").rowsBetween(Window.unboundedPreceding, 0)
    has, dated, known = F.col("x").isNotNull(), F.col("place").bitwiseAND(DATED) != 0, F.col("place").bitwiseAND(KNOWN) != 0
    is_row = F.col("place").between(ROW * STEP, BEHIND * STEP - 1)
    counted = events.select(
        *group, "place", "n", "m", has.alias("has"),
        *[F.coalesce(F.sum(F.when(counts, F.col("n"))).over(until), F.lit(0)).alias(name)
          for name, counts in (("w", is_row & has), ("wd", is_row & has & dated))])

    def total(value: Column, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    n, m = F.col("n"), F.col("m")
    return counted.groupBy(*group).agg(
        total(n * F.col("w"), ~is_row).alias("near"), total(n * F.col("wd"), ~is_row & dated).alias("near_dated"),
        total(n, is_row & F.col("has")).alias("w"), total(n, is_row & F.col("has") & dated).alias("wd"),
        total(n, ~is_row).alias("q"), total(n, ~is_row & dated).alias("qd"),
        total(n, is_row).alias("rows_a"), total(m, is_row).alias("rows_b"),
        total(n, is_row & known).alias("known_a"), total(m, is_row & known).alias("known_b"))


def _in_one_task(rows: DataFrame, reach: Reach | None) -> DataFrame:
    """The sums by key and day of rows dealt out by their slot: events are made, sorted and counted where the rows are."""
    return _counted(_events(_base(rows, reach, "slot"), reach, "slot"), "slot", "k", "day")


def _cut_by_amount(rows: DataFrame, reach: Reach | None, shares: int | None) -> DataFrame:
    """The sums by key and day of keys of any size, from events in range partitions."""
    # one task's share of the order each, cut inside a group where need be
    placed = _events(_base(rows, reach), reach).repartitionByRange("k", "day", "x", "place").withColumn("part", F.spark_partition_id())
    # the key first, wherever rows are sorted: its leading bytes tell most rows apart
    group = ["k", "day"]
    if shares:
        placed = placed.repartition(shares, *group, "part")
    parts = _counted(placed, *group, "part")
    if shares:
        parts = parts.repartition(shares, *group)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumns({
        "near": F.col("near") + F.col("q") * F.coalesce(F.sum("w").over(earlier), F.lit(0)),
        "near_dated": F.col("near_dated") + F.col("qd") * F.coalesce(F.sum("wd").over(earlier), F.lit(0))})
    return carried.groupBy(*group).agg(*[F.sum(c).alias(c) for c in SUMS])


def _shares(rows: DataFrame) -> tuple[int | None, int | None]:
    """The numbers of partitions that a large table's rows, and its events, are dealt into; None where the session's will do.

    AQE joins partitions, but never makes more than ``spark.sql.shuffle.partitions``: for a table that has grown
    beyond them the number follows Spark's estimate of its size (no job runs for it), so that a task's share
    stays the same. AQE also joins them by the bytes of what is shuffled: of rows, whose events come after the shuffle,
    it would join too many, so their number follows the size of any table of several shares."""
    plan = getattr(rows, "_jdf", None)  # none on a Spark Connect session
    if plan is None:
        return None, None
    size = int(plan.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        return None, None
    wanted, of_rows = min(size // SHARE_BYTES, MOST_SHARES), min(size // ROWS_SHARE_BYTES, MOST_SHARES)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = wanted if usual < wanted else None
    return of_rows if of_rows >= LEAST_SHARES else shares, shares


def _events(base: DataFrame, reach: Reach | None, *more: str) -> DataFrame:
    """(k, day, x, place, n, m, *more): rows and range ends, by key (no day) and again by key and date.

    place holds the place among events of one amount in steps of STEP, with the flags DATED and KNOWN of the row."""
    day_type, dated = base.schema["d"].dataType, F.col("d").isNotNull()
    has_x, has_k = F.col("x").isNotNull(), F.col("k").isNotNull()
    zero = F.lit(0).cast("long")
    flags = F.when(dated, DATED).otherwise(0) + F.when(F.col("known"), KNOWN).otherwise(0)

    def event(of_date: bool, x: Column, place: Column, n: Column, m: Column) -> Column:
        day = F.col("d") if of_date else F.lit(None).cast(day_type)
        return F.struct(day.alias("day"), x.alias("x"), (place * STEP + F.col("flags")).cast("int").alias("place"),
                        n.cast("long").alias("n"), m.cast("long").alias("m"))

    base = base.withColumn("flags", flags)
    made = [event(False, F.col("x"), F.lit(ROW), F.col("n_a"), F.col("n_b")),
            F.when(has_k & has_x & dated & (F.col("n_a") > 0), event(True, F.col("x"), F.lit(ROW), F.col("n_a"), zero))]
    if reach is not None:
        high, low = _upper(F.col("x"), reach), _lower(F.col("x"), reach)
        base = base.withColumns({"high": high[0], "high_place": high[1], "low": low[0], "low_place": low[1]})
        for of_date in (False, True):
            asks = has_k & has_x & (F.col("n_b") > 0) & (dated if of_date else F.lit(True))
            made += [F.when(asks, event(of_date, F.col("high"), F.col("high_place"), F.col("n_b"), zero)),
                     F.when(asks, event(of_date, F.col("low"), F.col("low_place"), -F.col("n_b"), zero))]
    return base.select("k", *more, F.explode(F.array(*made)).alias("e")).where("e IS NOT NULL").select(
        "k", "e.day", "e.x", "e.place", "e.n", "e.m", *more)
