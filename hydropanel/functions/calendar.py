"""Water years, seasons and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar months of each season.
SEASON_MONTHS = {
    "DJF": (12, 1, 2),
    "MAM": (3, 4, 5),
    "JJA": (6, 7, 8),
    "SON": (9, 10, 11),
}

# Position of a season in the water year.
SEASON_ORDER = {"SON": 1, "DJF": 2, "MAM": 3, "JJA": 4}


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def water_year(date, last_month: int = 9) -> Column:
    """Calendar year, plus one after ``last_month``."""
    d = as_col(date)
    return F.year(d) + (F.month(d) > last_month).cast("int")


def water_year_of(year, month, last_month: int = 9) -> Column:
    """Water year from separate year and month columns."""
    return as_col(year) + (as_col(month) > last_month).cast("int")


def season(month) -> Column:
    m = as_col(month)
    out = None
    for name, months in SEASON_MONTHS.items():
        out = F.when(m.isin(*months), name) if out is None else out.when(m.isin(*months), name)
    return out


def season_year(season_col, calendar_year, water_year_col) -> Column:
    """Autumn is grouped by calendar year, the other seasons by water year."""
    return F.when(as_col(season_col) == "SON", as_col(calendar_year)).otherwise(as_col(water_year_col))


def season_rank(season_col) -> Column:
    s = as_col(season_col)
    out = None
    for name, rank in SEASON_ORDER.items():
        out = F.when(s == name, F.lit(rank)) if out is None else out.when(s == name, F.lit(rank))
    return out


def date_parts(date) -> dict[str, Column]:
    d = as_col(date)
    return {"year": F.year(d), "month": F.month(d)}


def parse_date(text, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date, NULL when the text does not follow the format."""
    return F.try_to_timestamp(as_col(text), F.lit(fmt)).cast("date")


def excel_date(serial) -> Column:
    """Spreadsheet serial day number to date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), as_col(serial).cast("int"))


def years(lo, hi, step: int = 1) -> Column:
    """Array of years; empty when ``hi < lo`` (a plain sequence would count down)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(hi >= lo, F.sequence(lo, hi, F.lit(step))).otherwise(F.array().cast("array<int>"))


def month_days(month) -> Column:
    m = as_col(month)
    days = F.when(m == 2, F.lit(28))
    return days.when(m.isin(4, 6, 9, 11), F.lit(30)).when(m.between(1, 12), F.lit(31))


def month_depth(rate, month) -> Column:
    """Daily rate to monthly depth."""
    return as_col(rate) * month_days(month)
