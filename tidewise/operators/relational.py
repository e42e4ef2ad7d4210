"""Joins, unions, previews and shapes that the panel operators need."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.calendar import pattern_for
from ..functions.windows import micros, series
from .features import joined_back, require


def split_frame(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features and target."""
    return df.drop(target), df.select(target)


def split_on_date(df: DataFrame, time: str, date: object) -> tuple[DataFrame, DataFrame]:
    """Rows before the date, and from it on."""
    at = F.lit(date).cast(df.schema[time].dataType)
    return df.where(F.col(time) < at), df.where(F.col(time) >= at)


def filter_on_infs_nans(df: DataFrame) -> DataFrame:
    """Rows in which some column is null, NaN or infinite."""
    bad = F.lit(False)
    for f in df.schema:
        c = F.col(f.name)
        bad = bad | c.isNull()
        if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.where(bad)


def columns_of_type(df: DataFrame, include: Iterable[type] | None = None, exclude: Iterable[type] | None = None) -> list[str]:
    inside, outside = tuple(include or ()), tuple(exclude or ())
    return [f.name for f in df.schema if (not inside or isinstance(f.dataType, inside)) and not (outside and isinstance(f.dataType, outside))]


def non_numeric_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if not isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))})


def merge_actuals(predictions: DataFrame, actuals: DataFrame, time: str, keys: Sequence[str], target: str) -> DataFrame:
    """The predictions with known actuals; rows on either side stay, as in a full outer join."""
    if target in predictions.columns:
        return predictions
    on = [time, *keys]
    known = actuals.where(F.col(target).isNotNull()).select(*on, target)
    return predictions.join(known, on, "full")


def update_values(df: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with non-null values of second, on the full key."""
    new = [c for c in second.columns if c not in on and c in df.columns]
    right = second.select(*on, *(F.col(c).alias(f"__new_{c}") for c in new))
    out = joined_back(df, right, on)
    return out.withColumns({c: F.coalesce(f"__new_{c}", c) for c in new}).select(*df.columns)


def filter_on_keys(df: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows whose key is in `wanted`."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def merge_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left")


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "_sample_name") -> DataFrame:
    """All rows of all parts, with the part's name; columns that a part lacks are null."""
    out: DataFrame | None = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def repeated(df: DataFrame, doublings: int) -> DataFrame:
    """df, doubled so many times (for load tests)."""
    return df.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(2**doublings)))).drop("__n")


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.withColumns({v: F.col(v).cast("double") for v in values}).unpivot(list(ids), list(values), variable, value)


def preview(df: DataFrame, time: str, keys: Sequence[str], n: int = 1000) -> DataFrame:
    return df.orderBy(time, *keys).limit(n)


def missing_fractions(df: DataFrame) -> DataFrame:
    """(column, missing): the share of nulls, in one pass."""
    shares = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("int")).alias("missing")) for c in df.columns]
    return df.agg(F.array(*shares).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def date_differences(df: DataFrame, time: str) -> DataFrame:
    """The distinct whole days from the last date."""
    last = df.agg(F.max(time).alias("__last"))  # one row
    return df.select(time).distinct().join(F.broadcast(last), F.lit(True)).select(F.datediff(time, "__last").alias("days")).distinct()


def median_spacing(df: DataFrame, time: str) -> float | None:
    """Seconds between neighbouring distinct times, the median."""
    times = df.select(micros(df, time).alias("us")).distinct()
    gaps = times.select((F.lead("us").over(Window.orderBy("us")) - F.col("us")).alias("gap"))
    row = gaps.agg((F.percentile("gap", 0.5) / 1e6).alias("s")).first()
    return row["s"]


def format_dates(df: DataFrame, time: str, name: str | None = None) -> DataFrame:
    """The time as text, in the pattern that suits its median spacing."""
    seconds = median_spacing(df, time)
    return df.withColumn(name or time, F.date_format(time, pattern_for(86_400.0 if seconds is None else seconds)))


def top_features(importances: DataFrame, k: int, least: bool = False) -> DataFrame:
    """The k features of most (or least) importance; ties by name."""
    by = F.col("importance").asc() if least else F.col("importance").desc()
    return importances.orderBy(by, "feature").limit(k)


def hierarchy_column(df: DataFrame, keys: Sequence[str], name: str = "hierarchy") -> DataFrame:
    """The keys joined by '-', nulls left out; an empty text without keys."""
    return df.withColumn(name, F.concat_ws("-", *(F.col(k).cast("string") for k in keys)))


def first_rows_of_groups(df: DataFrame, time: str, keys: Sequence[str], n: int) -> DataFrame:
    require(df, keys)
    return df.withColumn("__rn", F.row_number().over(series(df, time, keys))).where(F.col("__rn") <= n).drop("__rn")


def covariates(df: DataFrame, time: str, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in (time, *keys)]


def drop_short_lags(df: DataFrame, min_lags: Mapping[str, int] | None, target: str | None = None) -> DataFrame:
    return df.drop(*names.too_short_lags(df.columns, min_lags, target))


def add_confidence_band(df: DataFrame, predicted: str, alpha: float = 0.975) -> DataFrame:
    """predicted +- the standard error of its mean times the normal quantile of alpha."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(alpha)
    error = df.agg((F.stddev_samp(predicted) / F.sqrt(F.count(predicted).cast("double")) * z).alias("__band"))  # one row
    out = df.join(F.broadcast(error), F.lit(True))
    return out.withColumns({f"{predicted}_upper": F.col(predicted) + F.col("__band"), f"{predicted}_lower": F.col(predicted) - F.col("__band")}).drop("__band")
