"""Rolling-origin folds, target masking and future frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """Positions of one fold: train is [0, train_end), test is [test_start, test_end)."""

    fold: int
    train_end: int
    test_start: int
    test_end: int


def fold_bounds(n: int, folds: int, gap: int = 0) -> list[Bounds]:
    """`folds` test blocks of n // (folds + 1) positions at the end, each after its train rows less a gap."""
    size = n // (folds + 1)
    if folds < 1 or size < 1 or n - folds * size - gap < 1:
        raise ValueError(f"{folds} folds with a gap of {gap} do not fit {n} positions")
    return [Bounds(k, n - (folds - k) * size - gap, n - (folds - k) * size, n - (folds - k - 1) * size) for k in range(folds)]


def positioned(df: DataFrame, time: str, keys: Sequence[str], unit: str = "date") -> tuple[DataFrame, int]:
    """df with __position, the rank of its date (or row), from 0, and the number of positions.

    Dates are ranked on the table of distinct dates, which is joined back.  A row's rank is the number of
    rows of earlier dates, summed on that table too, and its place by key among those of its own date.
    """
    if unit == "row":
        earlier = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
        dates = df.groupBy(time).agg(F.count("*").alias("__rows")).select(time, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__earlier"))
        out = df.join(dates, time).withColumn("__position", F.col("__earlier") + F.row_number().over(Window.partitionBy(time).orderBy(*(keys or [time]))) - 1)
        return out.drop("__earlier"), df.count()
    dates = df.select(time).distinct().withColumn("__position", F.row_number().over(Window.orderBy(time)) - 1)
    return df.join(dates, time), dates.count()


def fold_assignment(df: DataFrame, time: str, keys: Sequence[str], folds: int = 5, gap: int = 0, unit: str = "date") -> DataFrame:
    """Each row once per fold it is in, with fold and sample ('train' or 'test')."""
    ranked, n = positioned(df, time, keys, unit)
    p = F.col("__position")
    marks = [F.struct(F.lit(b.fold).alias("fold"), F.when(p < b.train_end, "train").when((p >= b.test_start) & (p < b.test_end), "test").alias("sample")) for b in fold_bounds(n, folds, gap)]
    out = ranked.withColumn("__fold", F.explode(F.array(*marks))).where(F.col("__fold.sample").isNotNull())
    return out.select(*df.columns, F.col("__fold.fold").alias("fold"), F.col("__fold.sample").alias("sample"))


def masked(df: DataFrame, target: str, is_train: F.Column, actual: str = "__actual") -> DataFrame:
    """The target null outside train, so that no feature sees it; its value is kept in `actual`."""
    return df.withColumn(actual, F.col(target)).withColumn(target, F.when(is_train, F.col(target)))


def future_frame(df: DataFrame, time: str, keys: Sequence[str], target: str, periods: int, freq: str = "1 day", include_history: bool = True) -> DataFrame:
    """The next `periods` times after the panel's last, for every series, with a null target."""
    last = df.agg(F.max(time).alias("__last"))  # one row
    who = df.select(*keys).distinct() if keys else df.select(F.lit(1).alias("__one")).limit(1)
    step = F.expr(f"interval {freq}")
    ahead = who.join(F.broadcast(last), F.lit(True))
    times = F.sequence(F.col("__last") + step, F.col("__last") + step * periods, step)
    ahead = ahead.select(*keys, F.explode(times).alias(time)).withColumn(time, F.col(time).cast(df.schema[time].dataType))
    ahead = ahead.withColumn(target, F.lit(None).cast(df.schema[target].dataType))
    return df.unionByName(ahead, allowMissingColumns=True) if include_history else ahead
