"""Column types found from text values, one for all files of a table.

Each value is a set of the types it can be, written as bits. Sets meet by
``bit_and``, so a column's type is an aggregation that combines map-side: one
long per column and task, whatever the number of files or the order of rows.
Values that are NULL or blank can be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import NUMBER_TEXT, SPECIAL_NUMBER_TEXT
from ..functions.names import column

SLASH_DATE_TEXT = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
ISO_DATE_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}$"
TIMESTAMP_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"

# Texts whose type is plain from the pattern alone, without reading the value: whole numbers that any long holds, and
# dates with the year last whose day every month has.
SHORT_WHOLE_TEXT = r"^[+-]?\d{1,18}\z"
_MONTH, _LATER = r"(?:0?[1-9]|1[0-2])", r"(?:1[3-9]|2[0-8])"  # a month or a day of its numbers; a day that is no month
PLAIN_DATE_TEXT = {("date, day first", "date, month first"): rf"^{_MONTH}([-/.]){_MONTH}\1\d{{4}}\z",
                   ("date, day first",): rf"^{_LATER}([-/.]){_MONTH}\1\d{{4}}\z",
                   ("date, month first",): rf"^{_MONTH}([-/.]){_LATER}\1\d{{4}}\z"}

# The types by name, the narrowest first. A column gets the first that all its values can be, else it stays text.
KINDS = {"boolean": "boolean", "whole": "bigint", "number": "double", "date": "date", "date, day first": "date",
         "date, month first": "date", "timestamp": "timestamp_ntz"}
BIT = {kind: 1 << i for i, kind in enumerate(KINDS)}


def _value(text: Column, kind: str) -> Column:
    """The text read as a type; NULL if it is none. Casts fail without the exception that a date pattern raises."""
    if kind in ("date, day first", "date, month first"):
        text = F.regexp_replace(text, SLASH_DATE_TEXT, "$4-$3-$1" if kind == "date, day first" else "$4-$1-$3")
    return text.try_cast(KINDS[kind])


def _trimmed(c: Column) -> Column:
    """The text without blanks around it; NULL if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _possible(text: Column) -> Column:
    """The types that a text can be, as bits; NULL where it holds nothing.

    A whole number can be a number too, a date of the ISO form a timestamp, and a date
    with the year last either of two where its day is at most 12. What begins like no
    number and no date is tried as neither. A pattern is tried only where the signs that
    it needs stand in their places, since each try costs more than the rest of the test."""
    def bits(*kinds: str) -> Column:
        return F.lit(sum(BIT[k] for k in kinds)).cast("long")

    def if_read(kind: str) -> Column:
        return F.when(_value(text, kind).isNotNull(), bits(kind)).otherwise(bits())

    def sign(at: int, *signs: str) -> Column:
        return F.substring(text, at, 1).isin(*signs)

    whole = (F.translate(text, "+-0123456789", "") == "") & _value(text, "whole").isNotNull()
    begins, year_last, year_first = F.substring(text, 1, 1), sign(2, "-", "/", ".") | sign(3, "-", "/", "."), sign(5, "-")
    first, *others = PLAIN_DATE_TEXT.items()
    slash_date = F.when(text.rlike(first[1]), bits(*first[0]))
    for kinds, pattern in others:
        slash_date = slash_date.when(text.rlike(pattern), bits(*kinds))
    slash_date = slash_date.otherwise(if_read("date, day first") + if_read("date, month first"))
    return (F.when(text.isNull(), F.lit(None).cast("long"))
            .when(begins.between("0", "9") | begins.isin("+", "-", "."), F.when(
                text.rlike(SHORT_WHOLE_TEXT), bits("whole", "number"))
                .when(year_last & text.rlike(SLASH_DATE_TEXT), slash_date)
                .when(year_first & text.rlike(ISO_DATE_TEXT), F.when(_value(text, "date").isNotNull(), bits("date", "timestamp")).otherwise(bits()))
                .when(year_first & text.rlike(TIMESTAMP_TEXT), if_read("timestamp"))
                .when(text.rlike(NUMBER_TEXT), F.when(whole, bits("whole", "number")).otherwise(bits("number")))
                .when(text.rlike(SPECIAL_NUMBER_TEXT), bits("number")).otherwise(bits()))
            .when(F.lower(text).isin("true", "false"), bits("boolean"))
            .when(text.rlike(SPECIAL_NUMBER_TEXT), bits("number")).otherwise(bits()))


def _column_bits(df: DataFrame, names: list[str]) -> DataFrame:
    """(at, bits): the types that all values of the column at that place can be; no row for a table without rows."""
    # one small expression over (column, text) rows; a wide one, of all columns and types, would be too large to compile
    texts = df.select(F.posexplode(F.array(*[_trimmed(column(n)) for n in names])).alias("at", "text"))
    # tested in a projection of its own: the aggregate names its argument three times, and would test each text as often
    return texts.select("at", _possible(F.col("text")).alias("bits")).groupBy("at").agg(F.bit_and("bits").alias("bits"))


def column_types(df: DataFrame, names: list[str] | None = None) -> dict[str, str]:
    """The type of each text column (all, unless ``names``): a name of ``KINDS``, or ``text``. A date
    whose day and month can be told from no value is read with the day first, as the date cleaner does.

    One job over the table, its result a row per column. A column without a value, and
    any column of a table without rows, is text."""
    names = df.columns if names is None else names
    if not names:
        return {}
    found = dict(tuple(r) for r in _column_bits(df, names).collect())  # a row per column
    return {n: next((k for k in KINDS if (found.get(i) or 0) & BIT[k]), "text") for i, n in enumerate(names)}


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns read as the types given for them; blank texts are NULL there, columns of the type ``text`` (and
    those not named) stay as they are, and so does a table's order of columns."""
    def read(name: str) -> Column:
        kind = types.get(name, "text")
        return column(name) if kind == "text" else _value(_trimmed(column(name)), kind).alias(name)

    return df.select(*[read(n) for n in df.columns])


def infer_types(df: DataFrame, rejected: str | None = None) -> DataFrame:
    """A table of text columns with the types that fit all its values.

    Rows with a text in the column ``rejected``, which stays text, have no say: what
    does not fit the others' types is NULL in them."""
    names = [n for n in df.columns if n != rejected]
    good = df if rejected is None else df.where(column(rejected).isNull())
    return with_types(df, column_types(good, names))
