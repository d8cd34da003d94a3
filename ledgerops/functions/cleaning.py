"""Column -> Column cleaning functions (amounts, dates, booleans, formats, text).

Every function returns a plain ``Column`` built from ``pyspark.sql.functions``:
no Python UDF, so the expressions compile into whole-stage codegen and also run
unchanged on streaming DataFrames. Casts that may fail use ``try_cast`` so that
ANSI mode turns bad input into NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import column

# Accepted boolean words, output date formats and number formats
# (must equal the original tool's values for equal results).
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")
DATE_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "DD-MMM-YYYY": "dd-MMM-yyyy",
}
DEFAULT_DATE_FORMAT = "YYYY-MM-DD"
NUMBER_FORMATS = ("0.00", "0", "0.000", "0.0000")

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return column(c) if isinstance(c, str) else c


def amount_parts(c: ColumnOrName) -> tuple[Column, Column]:
    """Amount text -> its digits, dots and minus signs (everything else is dropped), and the sign of ``(x)``."""
    text = _col(c).cast("string")
    trimmed = F.trim(text)
    in_parens = trimmed.like("(%)")
    source = F.when(in_parens, F.btrim(trimmed, F.lit("()"))).otherwise(text)
    return F.regexp_replace(source, r"[^0-9.\-]", ""), F.when(in_parens, F.lit(-1)).otherwise(F.lit(1))


def parse_amount(kept: ColumnOrName, sign: ColumnOrName) -> Column:
    """The number that ``amount_parts`` stand for; NULL if they are none.

    Over this alphabet a text parses iff it has a digit, at most one dot and a
    minus only in front. Checking that first (plain string functions) spares the
    per-row exception a failed cast costs."""
    kept, sign = _col(kept), _col(sign)
    has_digit = F.length(F.translate(kept, ".-", "")) > 0
    one_dot = F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit(""))) <= 1
    minus_in_front = F.instr(F.substring(kept, 2, 1 << 30), "-") == 0
    return sign * F.when(has_digit & one_dot & minus_in_front, kept.try_cast("double"))


def clean_amount(c: ColumnOrName, data_type: T.DataType | None = None) -> Column:
    """Amount text -> DOUBLE.

    ``(x)`` (after trimming spaces) means minus x. Currency symbols, letters
    and thousands separators are removed; a comma is never a decimal mark.
    A column that is already numeric keeps its value: unchanged if its type is
    given, else as DOUBLE (the expression itself asks for the type, so numbers
    never take the detour through text).
    """
    col = _col(c)
    if isinstance(data_type, T.NumericType):
        return col
    parsed = parse_amount(*amount_parts(col))
    if data_type is not None:
        return parsed
    kind = F.typeof(col)  # a constant of the plan
    numeric = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    return F.when(numeric, col.cast("string").try_cast("double")).otherwise(parsed)


# Text read as a whole number when deciding day/month order
# (sign, digits, optional fraction and exponent, surrounding spaces).
NUMBER_PART_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INT_MAX = 2**31 - 1


def _whole_number(part: Column) -> Column:
    """A date part as an INTEGER the way the ledger SQL casts it: ``12.7`` is 13
    (half away from zero), ``1e1`` is 10, out of range or not a number is NULL."""
    value = F.round(part.try_cast("double"), 0)
    return F.when(part.rlike(NUMBER_PART_TEXT) & (F.abs(value) <= F.lit(INT_MAX)), value)


def clean_date(c: ColumnOrName) -> Column:
    """Date text -> ISO-shaped text (``YYYY-MM-DD`` when the input allows).

    ``____-__-__`` is kept. ``x/y/z``: if x > 12 it is day/month, else if y > 12
    it is month/day, else day/month; the result is ``z-MM-DD`` with both parts
    left-padded (and cut) to two characters. Anything else is kept as text.
    """
    text = _col(c).cast("string")
    first, second, third = (F.split_part(text, F.lit("/"), F.lit(i)) for i in (1, 2, 3))

    def iso(day: Column, month: Column) -> Column:
        return F.concat(third, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))

    slashed = (
        F.when(_whole_number(first) > 12, iso(first, second))
        .when(_whole_number(second) > 12, iso(second, first))
        .otherwise(iso(first, second))
    )
    return F.when(text.like("____-__-__"), text).when(text.like("%/%/%"), slashed).otherwise(text)


def clean_boolean(c: ColumnOrName) -> Column:
    """Yes/No, Y/N, 1/0, T/F, True/False (any case, padded) -> BOOLEAN; else NULL."""
    word = F.lower(F.trim(_col(c).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


# The text shape read as a date: optional spaces, a year of any
# length, month and day of one or two digits with the same separator twice
# ('-', '/' or a space), optionally a time of day after spaces or 'T' (hour
# 0-23 or exactly 24:00[:00[.000]], minutes and seconds of one or two digits,
# an optional fraction, then an optional 'Z' or numeric UTC offset, or one
# space and a zone name such as 'UTC'), optional trailing spaces.
DATE_TEXT = (r"^\s*(\d+)([-/ ])(\d{1,2})\2(\d{1,2})"
             r"(?:(?:\s+|T)(?:(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d*)?)?|24:00(?::00(?:\.0*)?)?)"
             r"(?:Z|[+-]\d{2}(?::?\d{2})?| [A-Za-z0-9_/+\-:]+)?)?\s*$")


def parse_date(c: ColumnOrName, data_type: T.DataType | None = None) -> Column:
    """Text -> DATE when it has the date shape above and names a real day; else NULL.

    The shape is matched first, then rebuilt as zero-padded ``yyyy-MM-dd`` and
    cast, so a short year (``24-02-01``) is year 24 and ``2024-02-30`` is NULL.
    A DATE or timestamp column (by ``data_type``) is cast directly.
    """
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _col(c).cast("date")
    text = _col(c).cast("string")
    # Fast path, no pattern matching: exactly dddd-dd-dd, as cleaned dates are.
    plain_iso = text.like("____-__-__") & (F.translate(text, "0123456789", "") == F.lit("--"))
    iso_like = F.regexp_replace(text, DATE_TEXT, "$1-$3-$4")
    year, month, day = (F.split_part(iso_like, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    year = F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year)
    iso = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return (F.when(plain_iso, text.try_cast("date"))
            .when(text.rlike(DATE_TEXT), iso.try_cast("date")))


def date_pattern(fmt: str = DEFAULT_DATE_FORMAT) -> str:
    """The Spark pattern of a menu format; an unknown format falls back to ``YYYY-MM-DD``."""
    return DATE_FORMATS.get(fmt, DATE_FORMATS[DEFAULT_DATE_FORMAT])


def format_date(c: ColumnOrName, fmt: str = DEFAULT_DATE_FORMAT, data_type: T.DataType | None = None) -> Column:
    """Date (or ISO text) -> text in one of the four menu formats; an unparsable value is NULL.

    Give ``data_type`` for a DATE or timestamp column: it is then formatted as it
    is. To format one text several ways, parse it once in an own projection
    (``parse_date``) and format the result.
    """
    return F.date_format(parse_date(c, data_type), date_pattern(fmt))


def precision_of(fmt: str | None) -> int:
    """Digits after the dot of a number format (``0.00`` -> 2, ``0`` -> 0)."""
    if not fmt or "." not in fmt:
        return 0
    return len(fmt.split(".")[-1])


def format_number(c: ColumnOrName, precision: int = 2) -> Column:
    """Round to ``precision`` digits; the result stays DOUBLE.

    Computed as ``round_half_away(x * 10^p) / 10^p`` in floating point, as the
    spreadsheet-side SQL does: ``1.005`` gives ``1.0`` and ``2.675`` gives
    ``2.68`` at two digits (rounding the shortest decimal text instead would
    give ``1.01``). A tie after scaling is always an exactly representable
    ``.5``, so the integer rounding step itself is exact.
    """
    value = _col(c).cast("double")
    scale = F.lit(float(10 ** precision))
    scaled = F.round(value * scale, 0) / scale
    return F.when(F.abs(value) < F.lit(1e300), scaled).otherwise(value)


def to_text(c: ColumnOrName, data_type: T.DataType | None = None) -> Column:
    """Any value -> text.

    Floating point values are written as the ledger SQL writes them, from the
    same digits as Spark's: plain from 1e-4 up to 1e16 (``0.00012``,
    ``12345678901.5``), with a two-digit exponent outside (``1e+16``,
    ``1.5e-07``), and ``nan``, ``inf``, ``-inf``. The value's text is named many
    times: for whole columns give it in a projection of its own (``plain_text``).
    """
    col = _col(c)
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return col.cast("string")
    return plain_text(col, col.cast("string"))


def plain_text(value: Column, text: Column) -> Column:
    """A floating point value's text as the ledger SQL writes it, from Spark's own ``text`` of it."""
    mantissa, exponent = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2))
    short = F.when(mantissa.endswith(".0"), F.left(mantissa, F.length(mantissa) - 2)).otherwise(mantissa)
    minus = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    size, digits = F.abs(value), F.translate(short, "-.", "")
    places = F.translate(exponent, "-", "")
    scientific = F.concat(short, F.when(exponent.startswith("-"), "e-").otherwise("e+"),
                          F.when(F.length(places) < 2, F.concat(F.lit("0"), places)).otherwise(places))
    before = exponent.try_cast("int") + 1  # digits before the point
    behind = F.substr(digits, before + 1)
    plain = F.concat(minus, F.rpad(F.left(digits, before), before, F.lit("0")), F.lit("."),
                     F.when(behind == "", "0").otherwise(behind))
    small = F.concat(minus, F.lit("0.000"), digits)
    return (F.when(F.isnan(value), F.lit("nan"))
            .when(size == float("inf"), F.concat(minus, F.lit("inf")))
            .when(~text.contains("E"), text)
            .when((size >= 1e7) & (size < 1e16), plain)
            .when((size >= 1e-4) & (size < 1e-3), small)
            .otherwise(scientific))


# Text forms accepted as a number by the safe total (decimal
# notation with an optional exponent, or infinity / not-a-number).
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL_NUMBER_TEXT = r"^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def safe_double(c: ColumnOrName, data_type: T.DataType | None = None) -> Column:
    """Text or number -> DOUBLE, NULL where it does not parse.

    Text is tested against the number pattern before casting, so a column of
    words costs a pattern test per row instead of a failed cast.
    """
    col = _col(c)
    if isinstance(data_type, T.NumericType):
        return col.cast("double")
    text = col.cast("string")
    looks_numeric = text.rlike(NUMBER_TEXT) | text.rlike(SPECIAL_NUMBER_TEXT)
    return F.when(looks_numeric, text.try_cast("double"))
