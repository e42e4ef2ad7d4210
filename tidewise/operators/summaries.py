"""Error tables, cross-validation summaries and the long frames that plots draw from."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics

LEVELS = ((0.10, "best"), (0.15, "good"), (0.25, "bad"))


def row_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """df's rows with a known actual, and the five error columns; what is not finite is null."""
    a, p = metrics.finite(F.col(actual)), metrics.finite(F.col(predicted))
    out = df.where(F.col(actual).isNotNull())
    return out.withColumns({name: metrics.finite(f(a, p)) for name, f in metrics.ROW_METRICS.items()})


def described(df: DataFrame) -> DataFrame:
    return metrics.describe(df, list(metrics.ROW_METRICS))


def fold_errors(folds: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per fold and sample: rows and the mean of each error; folds holds fold and sample."""
    errors = row_errors(folds, actual, predicted)
    return errors.groupBy("fold", "sample").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in metrics.ROW_METRICS))


def summarised(errors: DataFrame, how: str = "median", fold: int | None = None, metric: str = "Absolute Percent Error") -> DataFrame:
    """One row per sample with the weighted average (by actuals) or median of a metric."""
    rows = errors if fold is None else errors.where(F.col("fold") == fold)
    value = metrics.weighted_mean(F.col(metric), F.col("Actuals")) if how == "weighted" else F.percentile(metric, 0.5)
    return rows.groupBy("sample").agg(value.alias("value"))


def level(error: float | None) -> str | None:
    """best, good, bad or worst."""
    if error is None:
        return None
    return next((name for most, name in LEVELS if error <= most), "worst")


ADVICE = {
    ("best", "best"): "The model is accurate and fits both samples alike; it is ready for use.",
    ("good", "best"): "The model is good; a few more features may still improve it.",
    ("bad", "best"): "The model learns too little: add features or let it grow.",
    ("worst", "best"): "The model learns very little: revisit the data and the features.",
}
OVERFIT = "The model fits what it has seen much better than what it has not: simplify it or add data."


def summarize_cv(medians: Mapping[str, float | None], weighted: Mapping[str, float | None]) -> dict[str, Any]:
    """score, fit, key_stats, performance and recommendation of a cross-validation, from the median and
    weighted percent errors of its train and test samples."""
    inside, outside = medians.get("train"), medians.get("test")
    score = level(outside)
    fit = level(None if inside is None or outside is None else abs(outside - inside))
    skew = None
    if outside is not None and weighted.get("test") is not None:
        skew = "large series are forecast worse than small ones" if weighted["test"] > outside else "large series are forecast as well as small ones, or better"
    shown = lambda x: "unknown" if x is None else f"{x:.0%}"
    advice = OVERFIT if fit in ("bad", "worst") else ADVICE.get((score, "best"))
    return {
        "score": score,
        "fit": fit,
        "key_stats": {"in_sample": inside, "out_of_sample": outside, "weighted_out_of_sample": weighted.get("test")},
        "performance": f"Half of all forecasts are off by less than {shown(outside)} ({shown(inside)} in sample); {skew or 'the errors by size are unknown'}.",
        "recommendation": advice,
    }


def summarize_importances(rows: list[tuple[str, float]], derived: tuple[str, ...] = ("_roll", "_lag", "_ewma"), alarm: float = 0.33) -> dict[str, Any]:
    """Shares of the top and bottom four features, and an alert if derived ones carry most."""
    total = sum(v for _, v in rows) or 1.0
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    share = sum(v for n, v in rows if any(d in n for d in derived)) / total
    return {
        "top": [(n, v / total) for n, v in ranked[:4]],
        "bottom": [(n, v / total) for n, v in ranked[-4:]],
        "derived_share": share,
        "alert": f"{share:.0%} of importance lies with features made from the target's own past" if share > alarm else None,
    }


def errors_by_fold_frame(folds: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(fold, sample, metric, value) of every row: what box plots by fold draw."""
    errors = row_errors(folds, actual, predicted)
    return errors.unpivot(["fold", "sample"], list(metrics.ROW_METRICS), "metric", "value")


def predictions_frame(df: DataFrame, time: str, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """(time, keys, series, value): actuals and forecasts over time."""
    both = df.select(time, *keys, F.col(actual).cast("double").alias("Actual"), F.col(predicted).cast("double").alias("Prediction"))
    return both.unpivot([time, *keys], ["Actual", "Prediction"], "series", "value")
