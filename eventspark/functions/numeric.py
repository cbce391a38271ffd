"""IEEE division, population statistics and number text, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def fdiv(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles: 0/0 is NaN, x/0 is an infinity; null if either is null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, a / F.when(b != 0, b)).otherwise(by_zero)


def present(v: Column) -> Column:
    """Neither null nor NaN."""
    return v.isNotNull() & ~F.isnan(v)


def derived_mean(total: Column, n: Column, float32: bool = False) -> Column:
    return _narrow(fdiv(total, n), float32)


def derived_std(total: Column, squares: Column, n: Column, float32: bool = False) -> Column:
    """Population standard deviation from sums. ``float32`` rounds after every step as single precision would."""
    mean = derived_mean(total, n, float32)
    variance = _narrow(_narrow(fdiv(squares, n), float32) - _narrow(mean * mean, float32), float32)
    return _narrow(F.pow(variance, F.lit(0.5)), float32)


def _narrow(c: Column, float32: bool) -> Column:
    return c.cast("float").cast("double") if float32 else c


def float_text(v: Column) -> Column:
    """Decimal text of a number, without an exponent from 1e-3 up to 1e16."""
    plain = v.cast("string")
    wide = F.format_string("%.1f", v.cast("double"))
    return F.when((F.abs(v) >= 1e7) & (F.abs(v) < 1e16) & (v == F.floor(v)), wide).otherwise(plain)
