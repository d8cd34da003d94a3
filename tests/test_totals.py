"""Sums of doubles that are exact and rounded once, whatever the order of rows and tasks."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerops.operators import aggregation as agg
from ledgerops.operators import analysis as an
from ledgerops.operators.totals import exact_totals

SMALLEST, LARGEST = 5e-324, 1.7976931348623157e308


def nearest(values):
    """The nearest double of the exact sum, by whole numbers."""
    total = sum((Fraction(v) for v in values), Fraction(0))
    try:
        return total.numerator / total.denominator
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def total(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return exact_totals(df, [], {"t": F.col("x")}).first()["t"]


def test_values_side_by_side(spark):
    rng = np.random.default_rng(7)
    wide = np.ldexp(rng.standard_normal(40), rng.integers(-1070, 1000, 40)).tolist()
    cases = {
        "cancelled": [1e308, 1.0, -1e308], "tiny": [SMALLEST] * 3, "tiny and large": [LARGEST, SMALLEST, -LARGEST],
        "cents": [0.1] * 10, "halfway, even": [2.0**53, 1.0], "halfway, up": [2.0**53, 1.0, SMALLEST],
        "halfway, down": [2.0**53, 1.0, -SMALLEST], "halfway, odd": [2.0**53 + 2, 1.0], "zeros": [0.0, -0.0],
        "nothing left": [0.1, 0.2, -0.1, -0.2], "negative": [-0.1, -0.7, 0.3], "near zero": [1.0, -1.0, -SMALLEST],
        "powers": [s * 2.0**e for e in range(-1074, 1024, 13) for s in (1, -1, 1)], "edges of limbs": [2.0**e - 1 for e in range(1, 53)],
        "beyond": [LARGEST, LARGEST], "beyond below": [-LARGEST, -LARGEST], "beyond and back": [LARGEST, LARGEST, -LARGEST],
        "wide": wide, "wide and turned": wide + [-v for v in wide[::2]], "subnormal": np.ldexp(rng.standard_normal(50), -1070).tolist(),
        "prices": (rng.integers(90000, 10500000, 500) / 100).tolist(),
    }
    rows = [(name, v) for name, values in cases.items() for v in values]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
        got = {r["g"]: r["t"] for r in exact_totals(df, ["g"], {"t": F.col("x")}).collect()}
        assert got == {name: nearest(values) for name, values in cases.items()}


@pytest.mark.parametrize("values, wanted", [
    ([1.0, math.inf], math.inf), ([-math.inf, 1e308], -math.inf), ([math.inf, -math.inf, 1.0], math.nan),
    ([math.nan, 1.0], math.nan), ([None, 2.5], 2.5), ([None, None], None), ([], None)])
def test_values_that_are_no_numbers(spark, values, wanted):
    got = total(spark, values)
    assert got == wanted or (wanted is not None and math.isnan(wanted) and math.isnan(got))


def test_groups_without_values_and_tables_without_rows(spark):
    df = spark.createDataFrame([(None, 1.5), (None, None), ("a", None)], "g string, x double")
    assert {r["g"]: tuple(r)[1:] for r in agg.aggregate(df, ["g"], "x", None).collect()} == {None: (2, 1.5), "a": (1, None)}
    assert agg.aggregate(df.limit(0), ["g"], "x", None).collect() == []
    assert tuple(an.column_stats(df.limit(0), "x").first()) == (0, None, None, None, None)
    assert tuple(agg.input_totals(df, "x").first()) == (3, 1.5)


def test_several_values_with_other_aggregates(spark):
    df = spark.createDataFrame([("a", 1e300, 0.1, 3), ("a", 1.0, 0.2, 9), ("a", -1e300, None, 4)], "g string, x double, y double, n int")
    got = exact_totals(df, ["g"], {"x": F.col("x"), "y": F.col("y")},
                       {"rows": (F.lit(1), "count"), "low": (F.col("n"), "min"), "high": (F.col("n"), "max"), "n": (F.col("n"), "sum")})
    assert got.columns == ["g", "rows", "low", "high", "n", "x", "y"]
    assert [tuple(r) for r in got.collect()] == [("a", 3, 3, 9, 16, 1.0, nearest([0.1, 0.2]))]


def test_same_bits_for_any_dealing(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(np.ldexp(rng.standard_normal(3000), rng.integers(-60, 60, 3000)))]
    df = spark.createDataFrame(rows, "g int, x double")
    results = {tuple(sorted(map(tuple, agg.aggregate(df.repartition(n).sortWithinPartitions("x"), ["g"], "x", None).collect()))) for n in (1, 2, 5, 16)}
    assert results == {tuple((g, 1000, nearest([v for h, v in rows if h == g])) for g in range(3))}
