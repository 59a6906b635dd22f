"""Identifiers, labels and number formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydropanel.functions.calendar import as_col

# Hydro-region numbers and names.
REGION_NAMES = {
    1: "Northern Parallel",
    2: "Central Canada",
    3: "Rocky Mountains",
    4: "Appalachians",
    5: "Northern Pacific Coast",
    6: "Southern Plains",
    7: "Northern Plains",
    8: "Central East",
    9: "Northern Atlantic",
    10: "Southwest",
    11: "Southern Pacific Coast",
    12: "Western Canada",
    13: "Rocky Lowland",
    14: "Pacific Northwest",
    15: "Great Lakes",
    16: "Southeast",
}


def strip(value, prefix: str) -> Column:
    """Remove every occurrence of a literal text."""
    return F.regexp_replace(as_col(value), re.escape(prefix), "")


def pad_id(value, n: int = 8) -> Column:
    """Put back one lost leading zero; longer ids are never cut."""
    v = as_col(value)
    return F.when(F.length(v) < n, F.concat(F.lit("0"), v)).otherwise(v)


def label(parts, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[as_col(p).cast("string") for p in parts])


def sign_label(value) -> Column:
    return F.when(as_col(value) > 0, "Positive").when(as_col(value) <= 0, "Inverse")


def sig_label(p) -> Column:
    p = as_col(p)
    return F.when(p.isNull(), "Insignificant").when(p > 0.05, "Marginally").otherwise("Significant")


def sigfig(value, n: int = 2) -> Column:
    """Value rounded to ``n`` significant figures (a number, zero stays zero).

    The exponent is taken from scientific notation, which is exact at powers of ten.
    """
    v = as_col(value)
    rounded = F.format_string(f"%.{n - 1}e", v).cast("double")
    return F.when(v.isNotNull(), rounded)


def sci(value, n: int = 2) -> Column:
    """Scientific notation with ``n`` decimals, blank for NULL."""
    v = as_col(value)
    return F.when(v.isNull(), " ").otherwise(F.format_string(f"%.{n}e", v))


def p_label(p, digits: int = 3) -> Column:
    p = as_col(p)
    return F.when(p < 0.001, "p<0.001").when(
        p.isNotNull(), F.concat(F.lit("p="), F.format_string(f"%.{digits}f", p))
    )
