"""Forecasting estimators on pyspark.ml, search over their parameters, and importances."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import pinball
from ..functions.windows import DAY, micros

SEED = 7
GRIDS: dict[str, dict[str, list[Any]]] = {
    "light": {"maxDepth": [3, 5], "stepSize": [0.05, 0.1], "maxIter": [20, 40], "subsamplingRate": [0.7, 1.0]},
    "full": {"maxDepth": [3, 5, 7], "stepSize": [0.02, 0.05, 0.1], "maxIter": [20, 50, 100], "subsamplingRate": [0.5, 0.7, 1.0], "featureSubsetStrategy": ["all", "0.5"], "minInstancesPerNode": [1, 5, 20]},
}
SEASONAL_GRIDS: dict[str, dict[str, list[Any]]] = {
    "light": {"regParam": [0.0, 0.1]},
    "full": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]},
}


def get_params(model: str = "gbt", size: str = "light") -> dict[str, list[Any]]:
    """The preset grid of a model."""
    return dict((SEASONAL_GRIDS if model == "trend_seasonal" else GRIDS if model in ("gbt", "median", "quantile") else {"light": {}, "full": {}})[size])


def estimator(model: str, quantile: float = 0.5, **params: Any) -> Any:
    """gbt (squared loss), median (absolute loss), tweedie, or trend_seasonal (linear in trend and waves).

    There is no built-in objective for other quantiles: median raises, and `fit` makes the model
    "quantile" of a median model and the quantiles of its errors.
    """
    if model == "gbt":
        return GBTRegressor(featuresCol="__features", labelCol="__label", predictionCol="__prediction", seed=SEED, **({"maxIter": 30, "maxDepth": 5} | params))
    if model == "median":
        if quantile != 0.5:
            raise ValueError("only the quantile 0.5 can be fitted")
        return GBTRegressor(featuresCol="__features", labelCol="__label", predictionCol="__prediction", seed=SEED, lossType="absolute", **({"maxIter": 30, "maxDepth": 5} | params))
    if model == "tweedie":
        return GeneralizedLinearRegression(featuresCol="__features", labelCol="__label", predictionCol="__prediction", family="tweedie", **({"variancePower": 1.5, "linkPower": 0.0, "regParam": 0.1} | params))
    if model == "trend_seasonal":
        return LinearRegression(featuresCol="__features", labelCol="__label", predictionCol="__prediction", **params)
    raise ValueError(f"unknown model {model!r}; there are gbt, median, tweedie, trend_seasonal")


def numeric_features(df: DataFrame, leave: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema if f.name not in leave and not f.name.startswith("__") and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def waves(df: DataFrame, time: str) -> tuple[DataFrame, list[str]]:
    """Trend in days, and yearly and weekly sines and cosines."""
    import math

    days = micros(df, time) / F.lit(float(DAY))
    new = {"__trend": days / 365.25}
    for name, period, order in (("y", 365.25, 3), ("w", 7.0, 2)):
        for k in range(1, order + 1):
            new[f"__sin_{name}{k}"] = F.sin(days * (2 * math.pi * k / period))
            new[f"__cos_{name}{k}"] = F.cos(days * (2 * math.pi * k / period))
    return df.withColumns(new), list(new)


#: Half of an interval that holds 80 % of normal errors, in standard deviations.
NORMAL_80 = 1.2815515655446004


@dataclass(frozen=True)
class Fitted:
    """A fitted model.  shifts: of a quantile model, the error's quantile by leaf; spread: of a seasonal
    one, the standard deviation of its errors."""

    model: str
    time: str
    columns: tuple[str, ...]
    pipeline: PipelineModel
    shifts: tuple[float, ...] = ()
    spread: float | None = None

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """df with a forecast; features that are missing count as -1 with a flag of their own.

        A seasonal model also gives an 80 % interval (name_lower, name_upper) and its components: trend
        (with the intercept), yearly and weekly, which sum to the forecast."""
        out = self.pipeline.transform(prepared(df, self.time, self.columns, self.model)[0])
        new = {name: F.col("__prediction")}
        if self.shifts:
            new[name] += F.element_at(F.array(*map(F.lit, self.shifts)), F.col("__leaf").cast("int") + 1)
        if self.spread is not None:
            width, own, linear = NORMAL_80 * self.spread, prepared_names(self.columns, self.model), self.pipeline.stages[-1]
            new |= {f"{name}_lower": new[name] - width, f"{name}_upper": new[name] + width}
            for part, mark in (("trend", "__trend"), ("yearly", "_y"), ("weekly", "_w")):
                terms = [F.col(c) * F.lit(float(b)) for c, b in zip(own, linear.coefficients, strict=True) if c == mark or c[5:7] == mark]
                new[part] = sum(terms, F.lit(float(linear.intercept) if part == "trend" else 0.0))
        return out.withColumns(new).select(*(c for c in df.columns if c not in new), *new)

    def importances(self, spark: Any) -> DataFrame:
        """(feature, importance): the trees' split gains, or absolute coefficients."""
        last = self.pipeline.stages[1]
        used = prepared_names(self.columns, self.model)
        values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(c) for c in last.coefficients.toArray()]
        return spark.createDataFrame([(n.removeprefix("__v_"), float(v)) for n, v in zip(used, values, strict=True)], "feature string, importance double")


def prepared_names(columns: Sequence[str], model: str) -> list[str]:
    if model == "trend_seasonal":
        return ["__trend", *(f"__{f}_{n}{k}" for n, o in (("y", 3), ("w", 2)) for k in range(1, o + 1) for f in ("sin", "cos"))]
    return [*(f"__v_{c}" for c in columns), *(f"__no_{c}" for c in columns)]


def prepared(df: DataFrame, time: str, columns: Sequence[str], model: str) -> tuple[DataFrame, list[str]]:
    if model == "trend_seasonal":
        df, _ = waves(df, time)
    else:
        missing = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
        df = df.withColumns({f"__v_{c}": F.when(missing[c], -1.0).otherwise(F.col(c).cast("double")) for c in columns} | {f"__no_{c}": missing[c].cast("double") for c in columns})
    return df, prepared_names(columns, model)


def fit(df: DataFrame, time: str, keys: Sequence[str], target: str, model: str = "gbt", quantile: float = 0.5, **params: Any) -> Fitted:
    """Fits on the rows whose target is present, one model for all series."""
    columns = tuple(numeric_features(df, [time, target]))
    data, used = prepared(df.where(F.col(target).isNotNull()), time, columns, model)
    data = data.withColumn("__label", F.col(target).cast("double"))
    stages = [VectorAssembler(inputCols=used, outputCol="__features"), estimator("median" if model == "quantile" else model, 0.5 if model == "quantile" else quantile, **params)]
    made = Pipeline(stages=stages).fit(data)
    if model == "quantile":
        return with_quantile(Fitted(model, time, columns, made), data, quantile)
    spread = made.transform(data).agg(F.stddev_pop(F.col("__label") - F.col("__prediction"))).first()[0] if model == "trend_seasonal" else None
    return Fitted(model, time, columns, made, spread=None if model != "trend_seasonal" else float(spread or 0.0))


def with_quantile(median: Fitted, data: DataFrame, quantile: float) -> Fitted:
    """A median model whose forecasts are shifted by the quantile of its errors, taken in each leaf of a
    shallow tree that tells small errors from large ones."""
    if not 0 < quantile < 1:
        raise ValueError("a quantile is between 0 and 1")
    errors = median.pipeline.transform(data).withColumn("__error", F.col("__label") - F.col("__prediction")).withColumn("__size", F.abs("__error"))
    tree = DecisionTreeRegressor(featuresCol="__features", labelCol="__size", predictionCol="__spread", leafCol="__leaf", maxDepth=3, minInstancesPerNode=30, seed=SEED).fit(errors)
    by_leaf = {int(r["__leaf"]): float(r["q"]) for r in tree.transform(errors).groupBy("__leaf").agg(F.percentile_approx("__error", quantile, 10_000).alias("q")).collect()}  # 8 leaves at most
    shifts = tuple(by_leaf.get(i, 0.0) for i in range(max(by_leaf, default=0) + 1))
    return Fitted("quantile", median.time, median.columns, PipelineModel([*median.pipeline.stages, tree]), shifts)


def quantile_weights(quantiles: Sequence[float] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95), weights: Sequence[float] = (0.2, 0.3, 0.9, 1.0, 0.9, 0.3, 0.2)) -> dict[float, float]:
    """Weights by quantile, for blending forecasts of several."""
    if len(quantiles) != len(weights) or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("each quantile, from 0 to 1, needs a weight")
    return dict(zip(quantiles, weights, strict=True))


def blended(df: DataFrame, forecasts: Mapping[float, str], name: str, weights: Mapping[float, float] | None = None) -> DataFrame:
    """df with the weighted mean of forecasts (quantile -> column); missing ones count for nothing, and
    a quantile without a weight raises."""
    weights = dict(weights) if weights is not None else quantile_weights()
    parts = [(F.col(c).cast("double"), weights[q]) for q, c in forecasts.items()]
    total = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return df.withColumn(name, F.try_divide(sum((F.coalesce(c * float(w), F.lit(0.0)) for c, w in parts), F.lit(0.0)), total))


def candidates(grid: Mapping[str, Sequence[Any]], strategy: str = "random", n_iter: int = 10, seed: int = SEED) -> list[dict[str, Any]]:
    """Parameter maps of a grid: all of it, or n_iter drawn without replacement."""
    names = sorted(grid)
    every = [dict(zip(names, values, strict=True)) for values in product(*(grid[n] for n in names))]
    if strategy == "grid" or len(every) <= n_iter:
        return every
    if strategy != "random":
        raise ValueError("strategy must be random or grid")
    return random.Random(seed).sample(every, n_iter)


def search(df: DataFrame, time: str, keys: Sequence[str], target: str, model: str, grid: Mapping[str, Sequence[Any]], strategy: str = "random", n_iter: int = 10, inner_folds: int | str = 3, quantile: float = 0.5) -> tuple[dict[str, Any], float | None]:
    """The parameters with the least error over folds of whole dates: rank modulo inner_folds, or one fold
    for each date ("each"), which fits every choice as often as there are dates."""
    choices = candidates(grid, strategy, n_iter)
    if len(choices) == 1:
        return choices[0], None
    known = df.where(F.col(target).isNotNull())
    if inner_folds == "each":
        inner_folds = max(2, known.select(time).distinct().count())
    dates = known.select(time).distinct().withColumn("__fold", (F.row_number().over(Window.orderBy(time)) % inner_folds).cast("int"))
    data = known.join(dates, time).cache()
    try:
        scores = []
        for params in choices:
            total = 0.0
            for k in range(inner_folds):
                fitted = fit(data.where(F.col("__fold") != k).drop("__fold"), time, keys, target, model, quantile, **params)
                out = fitted.predict(data.where(F.col("__fold") == k).drop("__fold"), "__p")
                a, p = F.col(target).cast("double"), F.col("__p")
                loss = pinball(a, p, quantile) if model in ("median", "quantile") else (a - p) * (a - p)
                total += out.agg(F.avg(loss)).first()[0] or 0.0
            scores.append(total / inner_folds)
        best = min(range(len(choices)), key=scores.__getitem__)
        return choices[best], scores[best]
    finally:
        data.unpersist()
