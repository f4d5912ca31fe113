"""Null-safe numeric column helpers (all JVM-side expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Coerce anything to double; unparseable text and NaN become null.

    Mirrors a lenient numeric coercion: surrounding whitespace is ignored,
    'NaN' is missing, 'inf' stays infinite.
    """
    c = col_of(c)
    d = F.trim(c.cast("string")).try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def nan_to_null(c) -> Column:
    return F.nanvl(col_of(c), F.lit(None).cast("double"))


def half_even(c, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals (numpy's rule)."""
    c = col_of(c)
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def clip(c, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip that keeps nulls null (``greatest(null, 0)`` would invent a 0).

    ``c`` is referenced twice: pass a column reference, not a deep expression.
    """
    c = col_of(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def row_mean(cols) -> Column:
    """Mean over columns of one row, skipping nulls; null when all are null."""
    cols = [col_of(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.when(count > 0, total / count)


def safe_div(num, den) -> Column:
    return F.try_divide(col_of(num), col_of(den))


def boundary(c, digits: int = 6) -> Column:
    """Round a computed double at the query boundary so engines compare equal."""
    return half_even(c, digits)
