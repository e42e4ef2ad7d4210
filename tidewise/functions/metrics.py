"""Error measures, as Column expressions over a row and as aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def absolute_error(a: Column, p: Column) -> Column:
    return F.abs(a - p)


def absolute_percent_error(a: Column, p: Column) -> Column:
    return F.abs(F.try_divide(a - p, a))


def absolute_percent_accuracy(a: Column, p: Column) -> Column:
    return F.lit(1.0) - absolute_percent_error(a, p)


def squared_error(a: Column, p: Column) -> Column:
    return (a - p) * (a - p)


def pinball(a: Column, p: Column, quantile: float) -> Column:
    return F.when(a >= p, F.lit(quantile) * (a - p)).otherwise(F.lit(1 - quantile) * (p - a))


def asymmetric_squared_error(a: Column, p: Column, penalty: float = 10.0) -> Column:
    """Squared error, times `penalty` where the forecast is too low."""
    return F.when(a > p, squared_error(a, p) * penalty).otherwise(squared_error(a, p))


ROW_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "Actuals": lambda a, p: a,
    "Predictions": lambda a, p: p,
    "Absolute Percent Error": absolute_percent_error,
    "Absolute Error": absolute_error,
    "Squared Error": squared_error,
}


def weighted_mean(value: Column, weight: Column) -> Column:
    """The weighted mean of the values that are present; null if their weights sum to 0."""
    there = value.isNotNull()
    return F.try_divide(F.sum(F.when(there, value * weight)), F.sum(F.when(there, weight)))


def mape(a: Column, p: Column) -> Column:
    return F.avg(absolute_percent_error(a, p))


def mapa(a: Column, p: Column) -> Column:
    return F.lit(1.0) - mape(a, p)


def mae(a: Column, p: Column) -> Column:
    return F.avg(absolute_error(a, p))


def mse(a: Column, p: Column, weight: Column | None = None) -> Column:
    return F.avg(squared_error(a, p)) if weight is None else weighted_mean(squared_error(a, p), weight)


def rmse(a: Column, p: Column, weight: Column | None = None) -> Column:
    return F.sqrt(mse(a, p, weight))


AGGREGATE_METRICS: dict[str, Callable[..., Column]] = {"mape": mape, "mapa": mapa, "mae": mae, "mse": mse, "rmse": rmse}


def score(df: DataFrame, actual: str, predicted: str, metric: str) -> DataFrame:
    """One row with the metric over rows whose actual is present."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.where(F.col(actual).isNotNull()).agg(AGGREGATE_METRICS[metric](a, p).alias(metric))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, std, min, exact quartiles and max, nulls left out."""
    stats = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    wide = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return wide.select("column", "count", "mean", "std", "min", *(F.try_element_at("q", F.lit(i + 1)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "max")
