"""SQL text for the oracle (DuckDB dialect) that restates each rule as a CASE.

These strings are what the correctness check runs next to our Spark plans;
they are independent formulations (five separate joins for reconcile, inline
CASE expressions for the cleaners), not used by the library itself.
"""

from __future__ import annotations

# Characters kept in amounts, boolean words and date formats (equal to the library's).
AMOUNT_KEEP = r"'[^0-9.\-]'"
BOOLEAN_TRUE = "('true', 'yes', 'y', '1', 't')"
BOOLEAN_FALSE = "('false', 'no', 'n', '0', 'f')"
STRFTIME = {
    "YYYY-MM-DD": "%Y-%m-%d",
    "DD/MM/YYYY": "%d/%m/%Y",
    "MM/DD/YYYY": "%m/%d/%Y",
    "DD-MMM-YYYY": "%d-%b-%Y",
}


def amount_sql(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return (
        f"(CASE WHEN trim({s}) LIKE '(%)' "
        f"THEN -1 * TRY_CAST(regexp_replace(trim(trim({s}), '()'), {AMOUNT_KEEP}, '', 'g') AS DOUBLE) "
        f"ELSE TRY_CAST(regexp_replace({s}, {AMOUNT_KEEP}, '', 'g') AS DOUBLE) END)"
    )


def date_sql(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    p1, p2, p3 = (f"split_part({s}, '/', {i})" for i in (1, 2, 3))

    def iso(day: str, month: str) -> str:
        return f"{p3} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0')"

    return (
        f"(CASE WHEN {s} LIKE '____-__-__' THEN {s} "
        f"WHEN {s} LIKE '%/%/%' THEN (CASE WHEN TRY_CAST({p1} AS INTEGER) > 12 THEN {iso(p1, p2)} "
        f"WHEN TRY_CAST({p2} AS INTEGER) > 12 THEN {iso(p2, p1)} ELSE {iso(p1, p2)} END) "
        f"ELSE {s} END)"
    )


def boolean_sql(x: str) -> str:
    w = f"lower(trim(CAST({x} AS VARCHAR)))"
    return f"(CASE WHEN {w} IN {BOOLEAN_TRUE} THEN TRUE WHEN {w} IN {BOOLEAN_FALSE} THEN FALSE END)"


def parse_date_sql(x: str) -> str:
    return f"TRY_CAST(CAST({x} AS VARCHAR) AS DATE)"


def format_date_sql(x: str, fmt: str) -> str:
    return f"strftime({parse_date_sql(x)}, '{STRFTIME.get(fmt, STRFTIME['YYYY-MM-DD'])}')"


def exact_sum_sql(x: str) -> str:
    """The sum of doubles as a whole number of units of 2^-60, made a double by one addition of two exact parts."""
    total = f"sum(CAST(CAST({x} AS DOUBLE) * 1152921504606846976 AS HUGEINT))"
    return (f"((CAST({total} // 1099511627776 AS DOUBLE) * 1099511627776 + CAST({total} % 1099511627776 AS DOUBLE))"
            " / 1152921504606846976)")


def summary_sql(ctes: str, a: str, b: str, tol: float) -> str:
    """Five separate statements' counts, side by side in one row."""
    return f"""
WITH {ctes},
pairs AS (
  SELECT a.d AS da, b.d AS db, a.amt AS aa, b.amt AS ab FROM {a} a JOIN {b} b ON a.k = b.k),
pc AS (
  SELECT count(*) FILTER (WHERE da = db AND abs(aa - ab) <= {tol}) AS e,
         count(*) FILTER (WHERE da <> db AND abs(aa - ab) <= {tol}) AS n,
         count(*) FILTER (WHERE abs(aa - ab) > {tol}) AS v,
         count(*) AS p
  FROM pairs),
mb AS (SELECT count(*) AS c FROM {a} a LEFT JOIN {b} b ON a.k = b.k WHERE b.k IS NULL),
ma AS (SELECT count(*) AS c FROM {b} b LEFT JOIN {a} a ON b.k = a.k WHERE a.k IS NULL),
ra AS (SELECT count(*) AS c FROM {a}),
rb AS (SELECT count(*) AS c FROM {b})
SELECT pc.e AS exact_matches, pc.n AS matches_with_date_note, pc.v AS amount_variances,
       mb.c AS missing_in_b, ma.c AS missing_in_a,
       pc.e + pc.n AS total_matched, pc.v + mb.c + ma.c AS total_unmatched,
       pc.p - pc.e - pc.n - pc.v AS unclassified, ra.c AS rows_a, rb.c AS rows_b
FROM pc, mb, ma, ra, rb
"""
