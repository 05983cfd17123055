"""Missing-value and float helpers.

Convention: missing is SQL NULL everywhere. NaN is turned into NULL on ingest, because
Spark sorts NaN above every number and calls ``NaN > 1`` true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def finite_or(c: Column, default) -> Column:
    """``c`` where it is a finite number, ``default`` elsewhere (NaN sorts above infinity)."""
    return F.coalesce(F.when(F.abs(c) < INF, c), as_column(default).cast("double"))


def float_div(a: Column, b: Column) -> Column:
    """IEEE division without the ANSI error: x/0 is +-inf, 0/0 is missing."""
    a, b = as_column(a), as_column(b)
    return (
        F.when(b != 0, F.try_divide(a, b))
        .when((b == 0) & (a > 0), F.lit(INF))
        .when((b == 0) & (a < 0), F.lit(-INF))
    )


def bound(c: Column, low: float, high: float) -> Column:
    """Bound a value that is known to be present; names ``c`` once, so it nests well."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clip(c: Column, low: float, high: float) -> Column:
    """Bound ``c``; a missing value stays missing (``greatest``/``least`` skip nulls)."""
    return F.when(c.isNotNull(), bound(c, low, high))


def where_present(value: Column, *inputs: Column) -> Column:
    """``value`` where every input is present, else missing."""
    known = F.lit(True)
    for c in inputs:
        known = known & c.isNotNull()
    return F.when(known, value)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def neutral_when_zero(c: Column, neutral: float = 0.5) -> Column:
    """Clean ``c`` (non-finite becomes 0) and read an exact 0 as ``neutral``."""
    cleaned = finite_or(c, 0.0)
    return F.when(cleaned == 0, F.lit(neutral)).otherwise(cleaned)
