"""Column functions with the engine's own null, NaN and zero rules; all stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def by(keys: list[str], order: str | list[str] = "as_of") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def divide(n: Column, d: Column) -> Column:
    """IEEE division under ANSI: x/0 is an infinity by the sign of x, 0/0 is NaN, null stays null."""
    n, d = n.cast("double"), d.cast("double")
    zero = F.when(n > 0, F.when(F.isnan(n), NAN).otherwise(INF)).when(n < 0, -INF).when(n.isNotNull(), NAN)
    return F.when(d == 0, zero).otherwise(F.try_divide(n, d))


def log(x: Column) -> Column:
    """Natural logarithm by IEEE: ln 0 is -inf, of a negative number NaN."""
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.ln(x))


def pct_change(x: Column, w: WindowSpec, periods: int = 1) -> Column:
    return divide(x, F.lag(x, periods).over(w)) - 1


def _full(x: Column, w: WindowSpec, window: int, value: Column) -> Column:
    frame = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(frame) == window, value.over(frame))


def rolling_mean(x: Column, w: WindowSpec, window: int) -> Column:
    """Null until the window has that many values."""
    return _full(x, w, window, F.avg(x))


def rolling_std(x: Column, w: WindowSpec, window: int) -> Column:
    return _full(x, w, window, F.stddev_samp(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def same(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    """Equal within tolerances; NaN and null are one value here."""
    none = lambda c: c.isNull() | F.isnan(c)
    close = (a == b) | (F.abs(a - b) <= F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol)))
    return F.when(none(a) | none(b), none(a) & none(b)).otherwise(close)


def average_rank(x: str, within: list[str]) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*within).orderBy(x)) + (F.count("*").over(Window.partitionBy(*within, x)) - 1) / 2.0


def bucket(within: list[str], order: list, quantiles: int) -> Column:
    """floor(position * quantiles / rows) + 1: sizes differ from ntile's where they don't divide evenly."""
    w = Window.partitionBy(*within)
    return (F.floor((F.row_number().over(w.orderBy(*order)) - 1) * quantiles / F.count("*").over(w)) + 1).cast("long")


def canonical_number(text: Column) -> Column:
    """A decimal text without exponent, trailing zeros or a negative zero; null if it isn't a number."""
    plain = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    return F.when(plain.isin("-0", "0E-18"), "0").otherwise(plain)
