"""Window specifications and aggregates over them, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000


def micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970 of a date or timestamp column (session time zone UTC)."""
    kind = df.schema[time].dataType
    return F.unix_micros(F.col(time) if isinstance(kind, T.TimestampType) else F.col(time).cast("timestamp"))


US = "__us"


def with_us(df: DataFrame, time: str) -> DataFrame:
    """df with the time in microseconds as a column.  Windows that order by one and the same column
    share one exchange and one sort, which windows over a repeated expression would not."""
    return df if US in df.columns else df.withColumn(US, micros(df, time))


def timed(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lends an operator (df, time, ...) the column of with_us; it stays only if df brought it."""

    @wraps(operator)
    def run(df: DataFrame, time: str, *args: Any, **kwargs: Any) -> DataFrame:
        out = operator(with_us(df, time), time, *args, **kwargs)
        return out if US in df.columns else out.drop(US)

    return run


def series(df: DataFrame, time: str, keys: Sequence[str]) -> WindowSpec:
    """One window per series, in time order."""
    return Window.partitionBy(*keys).orderBy(F.col(US) if US in df.columns else micros(df, time))


def trailing(spec: WindowSpec, days: float) -> WindowSpec:
    """The range (t - days, t]: open at its start, closed at its end."""
    return spec.rangeBetween(-(int(days * DAY) - 1), 0)


def _skew(x: Column, over: WindowSpec) -> Column:
    n = F.count(x).over(over).cast("double")
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.nanvl(F.skewness(x).over(over), F.lit(None).cast("double")))


def _kurt(x: Column, over: WindowSpec) -> Column:
    n = F.count(x).over(over).cast("double")
    return F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.nanvl(F.kurtosis(x).over(over), F.lit(None).cast("double")) + 6))


AGGREGATES: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "max": lambda x, o: F.max(x).over(o),
    "min": lambda x, o: F.min(x).over(o),
    "mean": lambda x, o: F.avg(x).over(o),
    "sum": lambda x, o: F.sum(x).over(o),
    "std": lambda x, o: F.when(F.count(x).over(o) > 1, F.stddev_samp(x).over(o)),
    "var": lambda x, o: F.when(F.count(x).over(o) > 1, F.var_samp(x).over(o)),
    "median": lambda x, o: F.percentile(x, 0.5).over(o),
    "count": lambda x, o: F.count(x).over(o).cast("double"),
    "skew": _skew,
    "kurt": _kurt,
}


def aggregate_over(name: str, x: Column, over: WindowSpec, min_periods: int = 1) -> Column:
    """A rolling aggregate that skips nulls, null where fewer than min_periods values are present."""
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregation {name!r}; there are {sorted(AGGREGATES)}")
    return F.when(F.count(x).over(over) >= min_periods, AGGREGATES[name](x, over))


def default_periods(window: int) -> int:
    """The number of values a window needs where none is given."""
    import math

    return math.ceil(window**0.8)
