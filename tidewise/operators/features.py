"""Leak-safe feature operators: DataFrame in, DataFrame with more columns out.

`keys` are the columns that name a series; none means one series.  Values are shifted by rows,
rolling windows are measured on the calendar: the value of n rows ago is taken first, then aggregated
over (t - days, t].  Operators on a series' own level are window columns, so plans hold one exchange
and one sort per set of keys, and no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import names
from ..functions.calendar import calendar
from ..functions.windows import DAY, US, aggregate_over, default_periods, micros, series, timed, trailing, with_us

LONG_SPAN = 10_000
COMPARE = {
    "greater": lambda x, t: x > t,
    "less": lambda x, t: x < t,
    "equal": lambda x, t: x == t,
    "not equal": lambda x, t: x != t,
}
COMPARE["not_equal"] = COMPARE["not equal"]
ROLL_UPS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),  # of nulls only: 0
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "median": F.median,
    "std": F.stddev_samp,
    "count": F.count,
}


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def shifted(df: DataFrame, feature: str, lag: int, over: WindowSpec) -> Column:
    return F.lag(F.col(feature), lag).over(over).cast("double") if lag else F.col(feature).cast("double")


@timed
def lag_features(df: DataFrame, time: str, keys: Sequence[str], features: Iterable[str] | str, lags: Iterable[int] | int, target: str | None = None) -> DataFrame:
    """The values of n rows ago; lags start at 1, lags of the target are doubles."""
    features, lags = names.as_list(features), [lags] if isinstance(lags, int) else list(lags)
    require(df, features)
    if any(n < 1 for n in lags):
        raise ValueError("lags must be at least 1")
    w = series(df, time, keys)
    return df.withColumns({names.lagged(f, n): F.lag(f, n).over(w).cast("double") if f == target else F.lag(f, n).over(w) for f in features for n in lags})


@timed
def difference_features(df: DataFrame, time: str, keys: Sequence[str], features: Iterable[str] | str, periods: int = 1) -> DataFrame:
    """The value less that of `periods` rows ago."""
    features = names.as_list(features)
    require(df, features)
    w = series(df, time, keys)
    return df.withColumns({names.differenced(f, periods): F.col(f) - F.lag(f, periods).over(w) for f in features})


def rolled_up(df: DataFrame, time: str, features: Iterable[str], columns: Sequence[str], operation: str = "sum") -> DataFrame:
    """The panel aggregated to columns and time; null keys are a group of their own."""
    if operation not in ROLL_UPS:
        raise ValueError(f"unknown operation {operation!r}; there are {sorted(ROLL_UPS)}")
    return df.groupBy(*columns, time).agg(*(ROLL_UPS[operation](F.col(f).cast("double")).cast("double").alias(f) for f in features))


def joined_back(df: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with right's other columns, null-safe on the keys; right has one row per key."""
    new = [c for c in right.columns if c not in on]
    left = df.drop(*new)
    renamed = right.select(*(F.col(c).alias(f"__{c}") for c in on), *new)
    condition = [left[c].eqNullSafe(renamed[f"__{c}"]) for c in on]
    return left.join(renamed, condition, "left").drop(*(f"__{c}" for c in on))


def with_group(df: DataFrame, time: str, keys: Sequence[str], features: list[str], groupers: Mapping[str, Any] | None, make: Any) -> DataFrame:
    """Applies make(df, keys, group) on the panel, or on its roll-up by `groupers` (name, columns,
    operation), whose new columns are joined back."""
    if not groupers:
        return make(df, list(keys), None)
    columns = names.as_list(groupers["columns"])
    require(df, columns)
    upper = make(with_us(rolled_up(df, time, features, columns, groupers.get("operation", "sum")), time), columns, groupers["name"])
    return joined_back(df, upper.drop(US, *features), [*columns, time])


@timed
def calc_statistical_features(
    df: DataFrame, time: str, keys: Sequence[str], features: Iterable[str] | str, windows: Iterable[int] = (7,), aggregations: Iterable[str] | str = ("max", "min", "std", "mean", "median"), lag: int = 1,
    groupers: Mapping[str, Any] | None = None, min_periods: int | None = 1, momentums: bool = False, percentages: bool = False,
) -> DataFrame:
    """Rolling statistics of lagged values; nulls are skipped, and fewer than min_periods values give
    null (none given: window ** 0.8, rounded up).  Momentum is the lagged value over the rolling mean,
    share that over the rolling sum."""
    features, aggregations, windows = names.as_list(features), names.as_list(aggregations), [windows] if isinstance(windows, int) else list(windows)
    require(df, features)
    if momentums and "mean" not in aggregations:
        raise ValueError("momentums need the aggregation mean")
    if percentages and "sum" not in aggregations:
        raise ValueError("percentages need the aggregation sum")

    def make(frame: DataFrame, own: list[str], group: str | None) -> DataFrame:
        w = series(frame, time, own)
        frame = frame.withColumns({f"__lag_{f}": shifted(frame, f, lag, w) for f in features})
        new = {
            names.rolled(f, a, days, lag, group): aggregate_over(a, F.col(f"__lag_{f}"), trailing(w, days), min_periods or default_periods(days))
            for f in features for days in windows for a in aggregations
        }
        frame = frame.withColumns(new)
        ratios = {}
        for f in features:
            for days in windows:
                for wanted, a, suffix in ((momentums, "mean", "_momentum"), (percentages, "sum", "_perc")):
                    if wanted:
                        name = names.rolled(f, a, days, lag, group)
                        ratios[name + suffix] = F.try_divide(F.col(f"__lag_{f}"), F.col(name))
        return (frame.withColumns(ratios) if ratios else frame).drop(*(f"__lag_{f}" for f in features))

    return with_group(df, time, keys, features, groupers, make)


def with_ewma(df: DataFrame, time: str, keys: Sequence[str], columns: Mapping[str, tuple[str, int, int]]) -> DataFrame:
    """Adds exponentially weighted means; columns: name -> (x, span, min_periods).

    Weights are (1 - a) ** age, a = 2 / (span + 1); a null leaves the mean as it was and ages what is before it.  A series is cut
    into blocks of as many rows as can matter in doubles, in which terms are weighted up instead of down:
    a mean is the ratio of running sums of a row's block plus the sums of the block before, so the work is
    linear in rows for any span, and nothing holds a whole series.
    """
    w = series(df, time, keys)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    at = micros(df, time) if US not in df.columns else F.col(US)
    out = df.withColumn("__at", at).withColumn("__rn", F.row_number().over(w) - 1)
    for name, (x, span, least) in columns.items():
        keep = 1 - 2 / (span + 1)
        size = math.ceil(math.log(1e-20) / math.log(keep)) if keep else 1
        there = F.col(x).isNotNull()
        up = F.pow(F.lit(1 / keep if keep else 1.0), F.col("__rn") % size)
        out = out.withColumns({"__block": F.floor(F.col("__rn") / size), "__num": F.when(there, F.col(x) * up), "__den": F.when(there, up)})
        own = Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*keys).orderBy("__block").rangeBetween(-1, -1)
        num, den = (F.coalesce(F.sum(c).over(own), F.lit(0.0)) + F.coalesce(F.sum(c).over(before), F.lit(0.0)) * (keep**size) for c in ("__num", "__den"))
        out = out.withColumns({"__mean": F.when(there, F.try_divide(num, den)), "__seen": F.count(x).over(running)})
        out = out.withColumn(name, F.when(F.col("__seen") >= least, F.last("__mean", ignorenulls=True).over(running))).drop("__block", "__num", "__den", "__mean", "__seen")
    return out.drop("__at", "__rn")


def ewma_by_pandas(df: DataFrame, time: str, keys: list[str], columns: dict[str, tuple[str, int, int, bool]]) -> DataFrame:
    """adjust=False (and spans over LONG_SPAN): one pass over each series; columns: name -> (x, span, min_periods, adjust)."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(US, kind="stable")
        for name, (x, span, least, adjust) in columns.items():
            frame[name] = frame[x].astype("float64").ewm(span=span, adjust=adjust, min_periods=least).mean()
        return frame

    return df.groupBy(*(F.col(k) for k in keys)).applyInPandas(smooth, schema)


@timed
def calc_ewma(
    df: DataFrame, time: str, keys: Sequence[str], features: Iterable[str] | str, windows: Iterable[int] = (7,), lag: int = 1, groupers: Mapping[str, Any] | None = None,
    min_periods: int | None = None, crossovers: bool = False, adjust: bool = True,
) -> DataFrame:
    """Exponentially weighted means of lagged values, spans in rows; crossovers are the ratios of every
    pair of spans, smaller over larger."""
    features, windows = names.as_list(features), sorted([windows] if isinstance(windows, int) else windows)
    require(df, features)
    if crossovers and len(windows) < 2:
        raise ValueError("crossovers need two windows or more")

    def make(frame: DataFrame, own: list[str], group: str | None) -> DataFrame:
        w = series(frame, time, own)
        frame = frame.withColumns({f"__lag_{f}": shifted(frame, f, lag, w) for f in features})
        short, long = {}, {}
        for f in features:
            for span in windows:
                name, least = names.smoothed(f, span, lag, group), min_periods or default_periods(span)
                if adjust and span <= LONG_SPAN:
                    short[name] = (f"__lag_{f}", span, least)
                else:
                    long[name] = (f"__lag_{f}", span, least, adjust)
        if short:
            frame = with_ewma(frame, time, own, short)
        if long:
            frame = ewma_by_pandas(frame, time, own, long)
        if crossovers:
            frame = frame.withColumns({names.crossed(f, a, b, lag, group): F.try_divide(names.smoothed(f, a, lag, group), names.smoothed(f, b, lag, group)) for f in features for a, b in combinations(windows, 2)})
        return frame.drop(*(f"__lag_{f}" for f in features))

    return with_group(df, time, keys, features, groupers, make)


@timed
def calc_percent_relative_to_threshold(
    df: DataFrame, time: str, keys: Sequence[str], features: Iterable[str] | str, windows: Iterable[int] = (7,), lag: int = 1, groupers: Mapping[str, Any] | None = None,
    min_periods: int | None = 1, threshold: float = 0, operator: str = "greater",
) -> DataFrame:
    """The share of lagged values in (t - days, t] that compare with the threshold; a null value counts
    as the threshold, a row without a lagged value does not count."""
    features, windows = names.as_list(features), [windows] if isinstance(windows, int) else list(windows)
    require(df, features)
    if operator not in COMPARE:
        raise ValueError(f"unknown operator {operator!r}; there are {sorted(COMPARE)}")

    def make(frame: DataFrame, own: list[str], group: str | None) -> DataFrame:
        w = series(frame, time, own)
        limit = F.lit(float(threshold))
        frame = frame.withColumns({f"__is_{f}": COMPARE[operator](F.coalesce(F.col(f).cast("double"), limit), limit).cast("double") for f in features})
        frame = frame.withColumns({f"__lag_{f}": shifted(frame, f"__is_{f}", lag, w) for f in features})
        new = {names.share_of_threshold(f, operator.replace(" ", "_"), threshold, days, lag, group): aggregate_over("mean", F.col(f"__lag_{f}"), trailing(w, days), min_periods or default_periods(days)) for f in features for days in windows}
        return frame.withColumns(new).drop(*(f"__is_{f}" for f in features), *(f"__lag_{f}" for f in features))

    return with_group(df, time, keys, features, groupers, make)


@timed
def calc_percent_change(df: DataFrame, time: str, keys: Sequence[str], feature: str, lag: int = 1, groupers: Mapping[str, Any] | None = None) -> DataFrame:
    """The lagged value over that of the row before it, less 1, within a series; a zero or null below
    gives null.  Groupers only change the keys; rows of one time are then ordered by the other keys."""
    require(df, [feature])
    own = names.as_list(groupers["columns"]) if groupers else list(keys)
    w = series(df, time, own)
    rest = [k for k in keys if k not in own]
    if rest:
        w = w.orderBy(US, *rest)
    x = F.col(feature).cast("double")
    ratio = F.try_divide(F.lag(x, lag).over(w) if lag else x, F.lag(x, lag + 1).over(w)) - 1
    return df.withColumn(names.changed(feature, lag, groupers["name"] if groupers else None), ratio)


@timed
def calc_days_since_release(df: DataFrame, time: str, keys: Sequence[str], target: str, ignore_leading_zeroes: bool = True) -> DataFrame:
    """Whole days since the series' first row with a positive target (or its first row at all).  Series
    that never sold are dropped, unless the panel has no keys."""
    from pyspark.sql import Window

    us = F.col(US)
    first = F.min(F.when(F.col(target) > 0, us) if ignore_leading_zeroes else us).over(Window.partitionBy(*keys))
    out = df.withColumn("__first", first)
    if keys:
        out = out.where(F.col("__first").isNotNull())
    return out.withColumn("days_since_release", F.floor((us - F.col("__first")) / F.lit(DAY)).cast("int")).drop("__first")


def calc_datetime_features(df: DataFrame, time: str, parts: Iterable[str] | str) -> DataFrame:
    return df.withColumns(calendar(time, names.as_list(parts)))


def join_demographics(df: DataFrame, dimension: DataFrame, joiner: str, level: str, attributes: Iterable[str] | None = None) -> DataFrame:
    """Inner join of a dimension table's attributes; its size decides how it is joined."""
    require(df, [joiner])
    wanted = names.as_list(attributes) or [c for c in dimension.columns if c != level]
    right = dimension.select(F.col(level).alias("__level"), *wanted)
    return df.drop(*wanted).join(right, F.col(joiner) == F.col("__level")).drop("__level")
