"""Column references by exact name.

Ledger exports use names such as ``trans date`` or ``amount.usd``; a dot in a
plain ``F.col`` name would mean a struct field. Every operator refers to the
table's top-level columns through ``column`` so that such names just work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The top-level column called exactly ``name``."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(names: list[str], name: str | None) -> str | None:
    """The table's own spelling of ``name``: exact if there is one, else the only name equal but for case.

    None when no name, or more than one, fits (SQL identifiers ignore case)."""
    if name is None or name in names:
        return name
    fits = [n for n in names if n.lower() == name.lower()]
    return fits[0] if len(fits) == 1 else None
