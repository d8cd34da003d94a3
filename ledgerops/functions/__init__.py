"""Column -> Column building blocks (cleaning, formatting, predicates)."""

from .cleaning import (
    DATE_FORMATS,
    FALSE_WORDS,
    NUMBER_FORMATS,
    TRUE_WORDS,
    clean_amount,
    clean_boolean,
    clean_date,
    format_date,
    format_number,
    parse_date,
    precision_of,
    safe_double,
    to_text,
)
from .predicates import (
    OPERATORS,
    between,
    combine,
    condition,
    contains,
    equals,
    gt,
    gte,
    like_escape,
    lt,
    lte,
)

__all__ = [
    "DATE_FORMATS",
    "FALSE_WORDS",
    "NUMBER_FORMATS",
    "OPERATORS",
    "TRUE_WORDS",
    "between",
    "clean_amount",
    "clean_boolean",
    "clean_date",
    "combine",
    "condition",
    "contains",
    "equals",
    "format_date",
    "format_number",
    "gt",
    "gte",
    "like_escape",
    "lt",
    "lte",
    "parse_date",
    "precision_of",
    "safe_double",
    "to_text",
]
