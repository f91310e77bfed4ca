"""Small expressions with the semantics that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(column: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string") != "", F.lit(False))


def zero(column: str | Column) -> Column:
    """A number, 0 where it is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("double"), F.lit(0.0))


def as_number(column: str | Column) -> Column:
    """Numeric text or a number as a double, anything else null."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast("double")


def chosen(column: str, value: str) -> Column:
    """Equality with a chosen value, where ``all`` switches the test off; null equals nothing."""
    return F.lit(True) if value == "all" else F.coalesce(F.col(column) == value, F.lit(False))


def within(column: str, values: Iterable[str]) -> Column:
    """Membership in a chosen set: ``all`` in it switches the test off, an empty set holds nothing."""
    values = list(values)
    if "all" in values:
        return F.lit(True)
    return F.coalesce(F.col(column).isin(values), F.lit(False)) if values else F.lit(False)


def ratio(part: Column, whole: Column, places: int = 0, scale: int = 1) -> Column:
    """scale * part / whole rounded half up to ``places`` decimals, 0 where whole is not positive.

    The rounding is done on whole numbers, so a tie is a tie in any engine.
    """
    k = scale * 10**places
    rounded = F.floor(F.try_divide(part.cast("double") * (2 * k) + whole, whole.cast("double") * 2)) / float(10**places)
    return F.when(whole > 0, rounded).otherwise(F.lit(0.0))


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """scale * part / whole, 0 where whole is not positive."""
    return F.when(whole > 0, F.try_divide(part.cast("double"), whole.cast("double")) * scale).otherwise(F.lit(0.0))


def banded(value: Column, bands: Iterable[tuple[float, str]]) -> Column:
    """The first band whose start a value reaches; the last one otherwise."""
    *upper, (_, last) = bands
    out = F.lit(last)
    for start, name in reversed(upper):
        out = F.when(value >= start, name).otherwise(out)
    return out
