"""Unit conversion, runoff efficiency and numeric transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydropanel.functions.calendar import as_col

# Fixed values: (multiplier, offset) from the first unit to the second.
UNIT = {
    ("ft3/s", "m3/s"): (0.028316846592, 0.0),
    ("in", "m"): (1 / 39.37, 0.0),
    ("ft", "m"): (1 / 3.281, 0.0),
    ("mm", "m"): (1 / 1000, 0.0),
    ("km2", "m2"): (1_000_000.0, 0.0),
    ("C", "K"): (1.0, 273.15),
    ("K", "C"): (1.0, -273.15),
}

# Seconds in the accounting periods.
SECONDS_YEAR = 31_536_000.0
SECONDS_MONTH = 2_628_002.88


def convert(value, unit_from: str, unit_to: str) -> Column:
    factor, offset = UNIT[(unit_from, unit_to)]
    out = as_col(value)
    if factor != 1.0:
        out = out * F.lit(factor)
    return out + F.lit(offset) if offset else out


def runoff_ratio(q, area, precip, seconds: float = SECONDS_YEAR) -> Column:
    """Discharge depth over precipitation depth; NULL when either divisor is zero."""
    return F.try_divide(F.try_divide(as_col(q) * F.lit(float(seconds)), as_col(area)), as_col(precip))


def log10_safe(value) -> Column:
    """NULL for zero and negative input."""
    v = as_col(value)
    return F.when(v > 0, F.log10(v))


def ln_safe(value) -> Column:
    v = as_col(value)
    return F.when(v > 0, F.log(v))


def pow10(value) -> Column:
    return F.pow(F.lit(10.0), as_col(value))


def depth_to_elev(depth, ref: float = 5.0) -> Column:
    return F.lit(float(ref)) - as_col(depth)


def null_if_beyond(value, limit: float = 9999.0) -> Column:
    v = as_col(value)
    return F.when(F.abs(v) < limit, v)


def max_of(*cols) -> Column:
    """Largest non-null value."""
    return F.greatest(*[as_col(c) for c in cols])


def signed_share(a, b) -> Column:
    """``a / (|a| + |b|)``."""
    a, b = as_col(a), as_col(b)
    return F.try_divide(a, F.abs(a) + F.abs(b))


def directed_share(a, b, total) -> Column:
    """``a / (a + b)`` normalised to absolute sum one, times the sign of ``total``."""
    a, b, total = as_col(a), as_col(b), as_col(total)
    pa, pb = F.try_divide(a, a + b), F.try_divide(b, a + b)
    return F.signum(total) * F.try_divide(pa, F.abs(pa) + F.abs(pb))


def rose_scale(value) -> Column:
    """``log10|b| + 2``; an empty coefficient has length zero."""
    v = as_col(value)
    return F.when((v == 0) | v.isNull(), F.lit(0.0)).otherwise(F.log10(F.abs(v)) + 2)


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(as_col(x1) - as_col(x2), 2) + F.pow(as_col(y1) - as_col(y2), 2))
