"""Address equality.

Four notions of "the same address" are in use and must not be mixed up.  Each is a
way to turn the five address columns into one text; two addresses are equal under a
notion when the texts are equal, so every lookup is a plain equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "exact"  # text as stored, null only equals null
IGNORE_CASE = "ignore_case"  # case ignored, null equals empty
TRIM_UPPER = "trim_upper"  # outer blanks and case ignored, null equals empty
BLANK_IS_NULL = "blank_is_null"  # as trim_upper, but blank state and postal code equal only null

MODES = (EXACT, IGNORE_CASE, TRIM_UPPER, BLANK_IS_NULL)


def _part(value: Column, mode: str, optional: bool) -> Column:
    if mode == IGNORE_CASE:
        value = F.upper(F.coalesce(value, F.lit("")))
    elif mode == TRIM_UPPER:
        value = F.coalesce(F.upper(F.trim(value)), F.lit(""))
    elif mode == BLANK_IS_NULL:
        value = F.upper(F.trim(value))
        if optional:
            value = F.nullif(value, F.lit(""))
    elif mode != EXACT:
        raise ValueError(f"unknown address mode {mode!r}")
    # The length in front keeps ('a|b', 'c') apart from ('a', 'b|c').
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def address_key(columns: Sequence[str | Column], mode: str) -> Column:
    """One text that is equal for two addresses exactly when they are equal under ``mode``."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("|", *[_part(v, mode, i in (2, 4)) for i, v in enumerate(values)])


def is_empty_address(columns: Sequence[str | Column]) -> Column:
    """All five parts are null or empty."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("", *[F.coalesce(v, F.lit("")) for v in values]) == ""


def has_required_parts(street: Column, city: Column, country: Column) -> Column:
    """Street, city and country are not blank."""
    return F.coalesce((F.trim(street) != "") & (F.trim(city) != "") & (F.trim(country) != ""), F.lit(False))


def standardise(column: str | Column) -> Column:
    """Text without outer blanks, null kept."""
    return F.trim(F.col(column) if isinstance(column, str) else column)
