"""Calendar parts of a timestamp."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = {
    "day": lambda t: F.dayofmonth(t).cast("int"),
    "day_of_week": lambda t: F.weekday(t).cast("int"),
    "weekend_flag": lambda t: F.weekday(t) >= 5,
    # Weeks start on Sunday; days before the first Sunday are in week 1.
    "week": lambda t: (F.floor((F.dayofyear(t) + 7 - F.dayofweek(t)) / 7) + 1).cast("int"),
    "month": lambda t: F.month(t).cast("int"),
    "year": lambda t: (F.year(t) % 100).cast("int"),
    "quarter": lambda t: F.quarter(t).cast("int"),
    "month_year": lambda t: F.date_format(t, "yy'M'MM"),
    "quarter_year": lambda t: F.concat(F.date_format(t, "yy"), F.lit("Q"), F.quarter(t).cast("string")),
}


def calendar(time: str, names: Iterable[str]) -> dict[str, Column]:
    """Column name -> expression; unknown names raise."""
    wanted = list(names)
    unknown = [n for n in wanted if n not in PARTS]
    if unknown:
        raise ValueError(f"unknown calendar parts {unknown}; there are {sorted(PARTS)}")
    return {n: PARTS[n](F.col(time)) for n in wanted}


#: Median spacing in seconds -> (strftime pattern, Spark pattern); the nearest is taken.
FORMATS = [
    (1.0, "%b. %-d %Y %H:%M:%S", "MMM. d yyyy HH:mm:ss"),
    (60.0, "%b. %-d %Y %H:%M", "MMM. d yyyy HH:mm"),
    (3600.0, "%b. %-d %Y %H:00", "MMM. d yyyy HH:00"),
    (86_400.0, "%b. %-d %Y", "MMM. d yyyy"),
    (604_800.0, "%b. %-d %Y", "MMM. d yyyy"),
    (2_629_800.0, "%b. %Y", "MMM. yyyy"),
    (31_557_600.0, "%Y", "yyyy"),
]


def pattern_for(seconds: float) -> str:
    """The Spark date pattern whose spacing is nearest."""
    return min(FORMATS, key=lambda f: abs(f[0] - seconds))[2]
