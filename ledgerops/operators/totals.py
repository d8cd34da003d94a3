"""Sums of doubles that don't depend on the order of rows or tasks.

A double is a whole number times a power of two. Every value is cut into four
limbs of 20 bits, aligned to powers of 2**20, so that the limbs of all values
with the same lowest power add up as longs: rows per group and power, combined
map-side. A group's few powers are then carried into one number and rounded to
a double once. The total is the exact sum's nearest double, for values of any
magnitude side by side. Sums of longs stay exact up to 2**43 rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import column

BITS = 20                 # of a limb
BASE = 1 << BITS
LIMBS = 4                 # of a value: 53 bits anywhere in them, and the error of a logarithm
CARRIES = 4               # further digits that a sum's carries can reach
DOUBLE_BITS = 54          # at least the bits of a double and one


def _scaled(x: str, power: str) -> str:
    """x * BASE**power as SQL, in two equal steps of which neither leaves the range of doubles."""
    step = f"pow(2D, ({power}) * {BITS // 2})"
    return f"({x}) * {step} * {step}"


def _with_limbs(rows: DataFrame) -> DataFrame:
    """``x`` cut into the limbs l0 (the lowest) to l3 above BASE**b, with its sign. All steps are exact, and each is made
    once, in a projection of its own. Zeros and values beyond the numbers have neither limbs nor ``b``."""
    usual = "x != 0 AND abs(x) < double('inf')"  # NaN is above all numbers here
    rows = rows.selectExpr("*", f"CASE WHEN {usual} THEN int(floor((floor(log2(abs(x))) - {DOUBLE_BITS}) / {BITS})) END AS b")
    rows = rows.selectExpr("*", f"{_scaled('abs(x)', '-b')} AS size", "CASE WHEN x < 0 THEN -1L ELSE 1L END AS sign")
    rows = rows.selectExpr("*", f"floor(size / {BASE**2}D) AS high")
    rows = rows.selectExpr("*", f"bigint(size - high * {BASE**2}D) AS low")
    limbs = [f"sign * {limb}" for half in ("low", "high") for limb in (f"({half} & {BASE - 1}L)", f"shiftright({half}, {BITS})")]
    return rows.selectExpr("*", *[f"{limb} AS l{i}" for i, limb in enumerate(limbs)])


def _carried(digits: str) -> str:
    """Signed sums, the lowest first -> digits from 0 to BASE-1 of the same number, and what is carried out of them."""
    return (f"aggregate({digits}, named_struct('carry', 0L, 'digits', CAST(array() AS array<bigint>)), (s, d) -> named_struct("
            f"'carry', shiftright(d + s.carry, {BITS}), 'digits', concat(s.digits, array((d + s.carry) & {BASE - 1}L))))")


def _rounded(merged: DataFrame) -> DataFrame:
    """``total`` of every row's ``sums`` (struct of a power b and the sums l of its limbs), ``beyond`` and ``n``."""
    top = CARRIES + LIMBS - 1
    # one digit for each power from the lowest up, then carries; a negative sum is carried again with its sign turned
    placed = merged.selectExpr("*", "array_min(transform(sums, s -> s.b)) AS first", f"array_max(transform(sums, s -> s.b)) + {top} AS last").selectExpr(
        "*", "CASE WHEN first IS NOT NULL THEN transform(sequence(first, last), p -> aggregate(sums, 0L, (t, s) -> t + coalesce(get(s.l, p - s.b), 0L))) END AS digits")
    carried = placed.selectExpr("*", f"{_carried('digits')} AS up").selectExpr(
        "*", f"CASE WHEN up.carry < 0 THEN {_carried('transform(digits, d -> -d)')}.digits ELSE up.digits END AS d")
    found = carried.selectExpr("*", "array_max(transform(d, (x, i) -> CASE WHEN x != 0 THEN i END)) AS top",
                               "array_min(transform(d, (x, i) -> CASE WHEN x != 0 THEN i END)) AS bottom")
    at = [f"coalesce(get(d, top - {back}), 0L)" for back in range(LIMBS)]
    # two exact doubles, the lower one with a last bit for all digits below: their sum is rounded once, the scale is exact
    upper = f"double({at[0]} * {BASE}L + {at[1]}) * {2 * BASE**2}D"
    lower = f"double(({at[2]} * {BASE}L + {at[3]}) * 2L + CASE WHEN bottom < top - 3 THEN 1L ELSE 0L END)"
    size = _scaled(f"({upper} + {lower}) / 2D", "first + top - 3")
    return found.selectExpr("*", f"CASE WHEN n > 0 THEN coalesce(beyond, CASE WHEN up.carry < 0 THEN -1D ELSE 1D END * {size}, 0D) END AS total")


def is_inexact(kind: T.DataType) -> bool:
    """Whether sums of this type depend on their order."""
    return isinstance(kind, (T.DoubleType, T.FloatType))


def exact_totals(df: DataFrame, groups: list[str], values: dict[str, Column], others: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """``groups`` and, by name, the exact sum of every column of ``values`` as a double (NULL values are left out, a
    group without any is NULL), with further aggregates ``others``: the column that is aggregated and ``count``, ``sum``,
    ``min`` or ``max``, which is how results of parts are put together too.

    Values that are infinite or no number give the total that doubles have: infinite,
    or no number. A total beyond the doubles is infinite. No rows and no groups: one row
    with NULL totals; no rows and groups: no row. A hot group is at most one row per
    power and task in a shuffle."""
    others = others or {}
    whole = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    parts = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    names = [f"g{i}" for i in range(len(groups))]
    # every value of a row is a row, so that each has a power of its own; the first carries the row's other aggregates
    rows = df.select(*[column(g).alias(n) for g, n in zip(groups, names)],
                     *[c.alias(f"o{i}") for i, (c, _) in enumerate(others.values())],
                     *[c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())])
    if len(values) == 1:
        rows = rows.withColumnRenamed("v0", "x").withColumn("v", F.lit(0))
    else:
        listed = F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(values))])).alias("v", "x")
        kept = [F.when(F.col("v") == 0, F.col(f"o{i}")).alias(f"o{i}") for i in range(len(others))]
        rows = rows.select(*names, *[f"o{i}" for i in range(len(others))], listed).select(*names, *kept, "v", "x")
    by_power = _with_limbs(rows).groupBy(*names, "v", "b").agg(
        *[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)],
        F.sum(F.when(F.abs("x") >= float("inf"), F.col("x"))).alias("beyond"), F.count("x").alias("n"),
        *[parts[how](f"o{i}").alias(f"o{i}") for i, (_, how) in enumerate(others.values())])
    merged = by_power.groupBy(*names, "v").agg(
        F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", F.array(*[f"l{i}" for i in range(LIMBS)]).alias("l")))).alias("sums"),
        F.sum("beyond").alias("beyond"), F.sum("n").alias("n"),
        *[whole[how](f"o{i}").alias(f"o{i}") for i, (_, how) in enumerate(others.values())])
    done = _rounded(merged)
    done = done.groupBy(*names).agg(
        *[F.max(F.when(F.col("v") == i, F.col("total"))).alias(f"t{i}") for i in range(len(values))],
        *[F.max(F.when(F.col("v") == 0, F.col(f"o{i}"))).alias(f"o{i}") for i in range(len(others))]) if len(values) > 1 or not groups \
        else done.withColumnRenamed("total", "t0")
    counts = [F.coalesce(f"o{i}", F.lit(0)) if how == "count" else F.col(f"o{i}") for i, (_, how) in enumerate(others.values())]
    return done.select(*[F.col(n).alias(g) for n, g in zip(names, groups)],
                       *[c.alias(name) for c, name in zip(counts, others)],
                       *[F.col(f"t{i}").alias(name) for i, name in enumerate(values)])
