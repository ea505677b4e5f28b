"""Column helpers for values that are missing, undefined or not finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def finite(c: Column) -> Column:
    """True for a number that is neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, or otherwise where b is zero or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise).cast("double"))


def nan_unless(ok: Column, value: Column) -> Column:
    """value where ok holds, else NaN."""
    return F.when(ok, value).otherwise(F.lit(NAN))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
