"""Brute-force checks: Spark results against plain Python on random small inputs."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerops.functions import cleaning as fc
from ledgerops.operators import reconciliation as rc

TOL = 0.5
keys = st.one_of(st.none(), st.integers(0, 4))
dates = st.one_of(st.none(), st.sampled_from([dt.date(2024, 1, 1), dt.date(2024, 1, 2)]))
amounts = st.one_of(st.none(), st.sampled_from([1.0, 1.25, 2.0, 5.0]))
rows = st.lists(st.tuples(keys, dates, amounts), max_size=12)


def brute_force(a, b):
    out = dict.fromkeys(["exact_matches", "matches_with_date_note", "amount_variances",
                         "missing_in_b", "missing_in_a", "unclassified"], 0)
    for ka, da, xa in a:
        for kb, db, xb in b:
            if ka is None or kb is None or ka != kb:
                continue
            delta = None if xa is None or xb is None else abs(xa - xb)
            if delta is not None and delta > TOL:
                out["amount_variances"] += 1
            elif delta is not None and da is not None and db is not None:
                out["exact_matches" if da == db else "matches_with_date_note"] += 1
            else:
                out["unclassified"] += 1
    keys_b = {k for k, _, _ in b if k is not None}
    keys_a = {k for k, _, _ in a if k is not None}
    out["missing_in_b"] = sum(1 for k, _, _ in a if k not in keys_b)
    out["missing_in_a"] = sum(1 for k, _, _ in b if k not in keys_a)
    out["rows_a"], out["rows_b"] = len(a), len(b)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=rows, b=rows)
def test_summary_matches_brute_force(spark, a, b):
    schema = "k long, d date, amt double"
    recon = rc.reconcile(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema),
                         rc.ReconConfig("k", rc.Roles("d", "amt"), rc.Roles("d", "amt"), TOL))
    got = recon.summary().first().asDict()
    want = brute_force(a, b)
    for name, value in want.items():
        assert got[name] == value, name
    assert recon.exact_matches.count() == want["exact_matches"]
    assert recon.missing_in_a.count() == want["missing_in_a"]


def python_amount(text):
    if text is None:
        return None
    trimmed = text.strip(" ")
    negative = trimmed.startswith("(") and trimmed.endswith(")") and len(trimmed) >= 2
    source = trimmed.strip("()") if negative else text
    kept = re.sub(r"[^0-9.\-]", "", source)
    try:
        value = float(kept)
    except ValueError:
        return None
    return -value if negative else value


amount_text = st.text(alphabet=list("0123456789.,-() $R"), max_size=10)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(amount_text, min_size=1, max_size=200))
def test_clean_amount_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(fc.clean_amount("v")).collect()]
    for text, value in zip(texts, got):
        assert value == python_amount(text), text


# -- filters and grouping ----------------------------------------------------------

from ledgerops.operators import aggregation as agg  # noqa: E402
from ledgerops.operators import filters as fl  # noqa: E402

records = st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "ab", "b_a"])),
                             st.one_of(st.none(), st.integers(-3, 3).map(float))), max_size=25)
conditions = st.lists(st.one_of(
    st.tuples(st.just("between"), st.tuples(st.integers(-3, 3).map(float), st.integers(-3, 3).map(float))),
    st.tuples(st.sampled_from(["gt", "lt", "gte", "lte", "equals"]), st.integers(-3, 3).map(float)),
    st.tuples(st.just("contains"), st.sampled_from(["a", "b", "_", "b_"])),
), min_size=1, max_size=3)


def _holds(op, value, text, number):
    """SQL truth of one condition: None (unknown) when the operand is NULL."""
    if op == "contains":
        if text is None:
            return None
        pattern = "^.*" + re.escape(value).replace("_", ".") + ".*$"  # '_' stays a one-character wildcard
        return re.match(pattern, text, re.S) is not None
    if number is None:
        return None
    if op == "between":
        return value[0] <= number <= value[1]
    return {"gt": number > value, "lt": number < value, "gte": number >= value,
            "lte": number <= value, "equals": number == value}[op]


def _combine(truths, mode):
    if mode == "AND":
        return False if False in truths else (None if None in truths else True)
    return True if True in truths else (None if None in truths else False)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=records, conds=conditions, mode=st.sampled_from(["AND", "OR"]))
def test_filter_matches_brute_force(spark, data, conds, mode):
    df = spark.createDataFrame(data, "t string, x double")
    specs = [{"column": "t" if op == "contains" else "x", "operator": op, "value": list(v) if op == "between" else v}
             for op, v in conds]
    got = sorted((r["t"] or "", r["x"] if r["x"] is not None else 99.0) for r in fl.filter_rows(df, specs, mode).collect())
    want = sorted((t or "", x if x is not None else 99.0) for t, x in data
                  if _combine([_holds(op, v, t, x) for op, v in conds], mode) is True)
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=records)
def test_grouping_matches_brute_force(spark, data):
    df = spark.createDataFrame(data, "t string, x double")
    got = {r["t"]: (r["record_count"], r["total_amount"]) for r in agg.aggregate(df, ["t"], "x", None).collect()}
    want = {}
    for t, x in data:
        count, total = want.get(t, (0, None))
        want[t] = (count + 1, total if x is None else (x if total is None else total + x))
    assert got == want
