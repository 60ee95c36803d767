"""Areas, tolerances and years, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.config import Settings


def sliver_threshold(a: Column, b: Column, settings: Settings = Settings()) -> Column:
    """Below this, a parcel of units with areas a and b is noise."""
    positive = lambda x: F.when(x > 0, x)
    return F.greatest(F.lit(settings.sliver_abs), F.coalesce(F.least(positive(a), positive(b)) * settings.sliver_rel, F.lit(0.0)))


def within_tolerance(value: Column, expected: Column, absolute: float, percent: float) -> Column:
    """False where either is null."""
    return F.coalesce(F.abs(value - expected) <= F.greatest(F.lit(float(absolute)), F.abs(expected) * (percent / 100)), F.lit(False))


def ratio(x: Column, y: Column, otherwise: float | None = None) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(otherwise).cast("double"))


def bracket(year: Column, vintages: Iterable[int]) -> tuple[Column, Column]:
    """The latest vintage before a year and the earliest after it, both strictly; null where there is none."""
    known = F.array(*(F.lit(int(v)) for v in sorted(vintages)))
    return F.array_max(F.filter(known, lambda v: v < year)), F.array_min(F.filter(known, lambda v: v > year))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero."""
    return F.round(x, digits)


def rounded_double(x: Column, digits: int) -> Column:
    """rounded, of a double: decimals, which take longer than most sums, are made only near a half and of what is large or not above 0.

    x stands in it more than once, so it should be a column.
    """
    scaled = x * 10.0**digits
    near = F.rint(scaled)
    # both numbers are whole and exact, so their quotient is the double nearest to the decimal
    return F.when((scaled > 0) & (scaled < 1e12) & (F.abs(scaled - near) < 0.499), near / 10.0**digits).otherwise(F.round(x, digits))
