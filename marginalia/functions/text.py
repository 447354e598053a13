"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def truncate_utf8(text: Column, most: int) -> Column:
    """``text`` if its UTF-8 form has at most ``most`` bytes, else as many whole
    characters as fit and an ellipsis (which isn't counted)."""
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, most - 4, -1) if n >= 0]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.coalesce(*cuts, F.lit("")), F.lit(ELLIPSIS)))


def date_timestamp(date: Column) -> Column:
    """The date string as a timestamp, null where it is none: an addition, the
    string stays what is compared."""
    return F.try_to_timestamp(date)
