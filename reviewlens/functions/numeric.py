"""Numeric and formatting Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """numpy-style rounding: ``rint(x * 10^d) / 10^d`` (ties to even on the scaled double)."""
    scale = float(10 ** digits)
    return F.rint(_c(c).cast("double") * F.lit(scale)) / F.lit(scale)


def trunc_int(c: Column | str) -> Column:
    """Python ``int()`` of a float: truncation toward zero, as BIGINT."""
    return _c(c).try_cast("bigint")


def nan_to_null(c: Column | str) -> Column:
    """The number as double, NaN as null: pandas has one notion of missing, Spark keeps NaN apart from NULL."""
    c = _c(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def is_missing(c: Column | str, data_type=None) -> Column:
    """``isnull`` in the pandas sense: NULL, or NaN for floating-point columns."""
    c = _c(c)
    from pyspark.sql.types import DoubleType, FloatType

    if isinstance(data_type, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage ``part / whole * 100`` rounded half-even; NULL when ``whole`` is 0."""
    return round_half_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def _fixed(c: Column, digits: int) -> Column:
    # DecimalFormat rounds half-even on the exact binary value, as Python's formatter does
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def format_percent(c: Column | str, digits: int = 2) -> Column:
    """Python ``f'{x:.2%}'`` for a fraction x, e.g. 0.98765 → ``98.77%``.

    Python multiplies by 100 and rounds the exact binary value of the product; Java's
    ``DecimalFormat`` (behind ``format_number``) rounds the same way, so the two agree
    where a ``rint(x * 10^4)`` shortcut would not (0.98765 · 10^4 = 9876.4999…).
    """
    c = _c(c).cast("double")
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(_fixed(c * F.lit(100.0), digits), F.lit("%")))


def format_fixed(c: Column | str, digits: int = 1) -> Column:
    """Python ``f'{x:.1f}'``: fixed decimals, no grouping."""
    c = _c(c).cast("double")
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(_fixed(c, digits))


def format_thousands(c: Column | str) -> Column:
    """Python ``f'{n:,}'`` for integers: ``1234`` → ``1,234``."""
    return F.format_number(_c(c).cast("bigint"), 0)
