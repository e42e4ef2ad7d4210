"""The panel: a table of series with a time, a target and the keys that name a series."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..operators import models, relational, split, summaries, transforms
from ..operators.features import join_demographics, require
from ..plans.specs import Context, ScalerSpec, Spec, fit_scalers, frozen, replay
from .tables import nan_as_null, read_json, write_json


@dataclass(frozen=True)
class Fold:
    """One fold of a cross-validation: forecasts on both samples, and what made them."""

    number: int
    train: DataFrame
    test: DataFrame
    params: dict[str, Any]
    error: float | None


@dataclass(frozen=True)
class Panel:
    """An immutable panel.  Methods return new panels or DataFrames; nothing runs before it must.

    `frame` holds the panel's own columns; recorded scalers and features are applied by `data()`.
    """

    frame: DataFrame
    time: str
    target: str
    keys: tuple[str, ...] = ()
    sample_size: int = 1000
    specs: tuple[Spec, ...] = ()
    scalers: tuple[ScalerSpec, ...] = ()
    codes: Mapping[str, DataFrame] = field(default_factory=dict)
    predictions: DataFrame | None = None
    model: models.Fitted | None = None
    folds: tuple[Fold, ...] = ()

    # Construction, export and state

    @classmethod
    def create(cls, df: DataFrame, datetime_column: str, target: str, hierarchy: str | Iterable[str] | None = None, sample_size: int = 1000, check: bool = True) -> Panel:
        """Checks the columns, parses the time, turns NaN into null and requires unique keys."""
        keys = tuple(names.as_list(hierarchy))
        require(df, [datetime_column, target, *keys])
        df = nan_as_null(df)
        if not isinstance(df.schema[datetime_column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            df = df.withColumn(datetime_column, F.to_timestamp(datetime_column))
        if check and not df.groupBy(*keys, datetime_column).count().where("count > 1").isEmpty():
            raise ValueError(f"{[*keys, datetime_column]} is not unique")
        return cls(df, datetime_column, target, keys, sample_size)

    @property
    def context(self) -> Context:
        return Context(self.time, self.keys, self.target)

    def data(self, min_lag_dict: Mapping[str, int] | None = None) -> DataFrame:
        """The panel, scaled and with all recorded features."""
        scaled, _ = fit_scalers(self.frame, self.scalers)
        return replay(scaled, self.specs, self.context, dict(min_lag_dict or {}))

    def to_pandas(self) -> Any:
        return self.data().toPandas()

    def get_sample(self) -> DataFrame:
        return relational.preview(self.data(), self.time, self.keys, self.sample_size)

    def show(self, n: int = 20) -> None:
        self.data().show(n)

    def covariates(self) -> list[str]:
        return relational.covariates(self.data(), self.time, self.keys)

    def missing_fractions(self) -> DataFrame:
        return relational.missing_fractions(self.data())

    def save(self, path: str) -> None:
        """Parquet for tables, folds too, JSON for the rest, the model in its own format."""
        self.frame.write.mode("overwrite").parquet(f"{path}/frame")
        if self.predictions is not None:
            self.predictions.write.mode("overwrite").parquet(f"{path}/predictions")
        for c, table in self.codes.items():
            table.write.mode("overwrite").parquet(f"{path}/codes/{c}")
        if self.model is not None:
            self.model.pipeline.write().overwrite().save(f"{path}/model")
        for f in self.folds:
            for sample, table in (("train", f.train), ("test", f.test)):
                table.write.mode("overwrite").parquet(f"{path}/folds/{f.number}/{sample}")
        state = {
            "folds": [[f.number, f.params, f.error] for f in self.folds], "time": self.time, "target": self.target, "keys": list(self.keys), "sample_size": self.sample_size, "codes": list(self.codes), "predictions": self.predictions is not None,
            "specs": [s.to_json() for s in self.specs], "scalers": [[s.kind, list(s.features), s.given] for s in self.scalers], "model": [self.model.model, list(self.model.columns), list(self.model.shifts), self.model.spread] if self.model else None,
        }
        write_json(self.frame.sparkSession, f"{path}/state", state)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Panel:
        s = read_json(spark, f"{path}/state")
        model = None
        if s["model"]:
            model = models.Fitted(s["model"][0], s["time"], tuple(s["model"][1]), models.PipelineModel.load(f"{path}/model"), tuple(s["model"][2]), s["model"][3])
        from ..plans.specs import thawed

        return cls(
            spark.read.parquet(f"{path}/frame"), s["time"], s["target"], tuple(s["keys"]), s["sample_size"], tuple(Spec.from_json(x) for x in s["specs"]),
            tuple(ScalerSpec(k, tuple(f), frozen(thawed(g)) if g else None) for k, f, g in s["scalers"]), {c: spark.read.parquet(f"{path}/codes/{c}") for c in s["codes"]},
            spark.read.parquet(f"{path}/predictions") if s["predictions"] else None, model,
            tuple(Fold(n, *(spark.read.parquet(f"{path}/folds/{n}/{sample}") for sample in ("train", "test")), params, error) for n, params, error in s["folds"]),
        )

    # Preparation: changes the frame

    def _with(self, frame: DataFrame) -> Panel:
        return replace(self, frame=frame)

    def correct_negatives(self, features: str | Iterable[str] | None = None, replace_value: float = 0) -> Panel:
        return self._with(transforms.correct_negatives(self.frame, names.as_list(features) or [self.target], replace_value))

    def fill_time_gaps(self, per_series: bool = False, fill_value: float | None = None, freq: str = "1 day") -> Panel:
        return self._with(transforms.fill_time_gaps(self.frame, self.time, self.keys, per_series, fill_value, freq))

    def fill_missings(self, method: str = "ffill", features: str | Iterable[str] | None = None) -> Panel:
        return self._with(transforms.fill_missings(self.frame, self.time, self.keys, method, features))

    def encode_categoricals(self) -> Panel:
        frame, codes = transforms.encode_categoricals(self.frame)
        return replace(self, frame=frame, codes={**self.codes, **codes})

    def decode_categoricals(self, data: DataFrame | None = None) -> DataFrame:
        return transforms.decode_categoricals(self.frame if data is None else data, self.codes)

    def compress(self, floats: bool = False) -> Panel:
        return self._with(transforms.compress(self.frame, floats))

    def join_demographics(self, dimension: DataFrame, joiner: str, level: str, attributes: Iterable[str] | None = None) -> Panel:
        return self._with(join_demographics(self.frame, dimension, joiner, level, attributes))

    def format_dates(self, data: DataFrame | None = None) -> DataFrame:
        return relational.format_dates(self.data() if data is None else data, self.time)

    # Scalers and features: recorded

    def _scaled(self, kind: str, features: str | Iterable[str], given: Mapping | None) -> Panel:
        features = tuple(names.as_list(features))
        require(self.frame, features)
        again = [f for s in self.scalers if s.kind == kind for f in s.features if f in features]
        if again:
            raise ValueError(f"{again} already have the scaler {kind}")
        return replace(self, scalers=(*self.scalers, ScalerSpec(kind, features, frozen(dict(given)) if given else None)))

    def log_features(self, features: str | Iterable[str]) -> Panel:
        return self._scaled("log1p", features, None)

    def standardize_features(self, features: str | Iterable[str], given: Mapping | None = None) -> Panel:
        return self._scaled("standardize", features, given)

    def normalize_features(self, features: str | Iterable[str], given: Mapping | None = None) -> Panel:
        return self._scaled("normalize", features, given)

    def descale_features(self) -> Panel:
        """The panel without its scalers: the frame was never changed by them."""
        return replace(self, scalers=())

    def _feature(self, operator: str, **arguments: Any) -> Panel:
        return replace(self, specs=(*self.specs, Spec.of(operator, **arguments)))

    def lag_features(self, features: str | Iterable[str], lags: int | Iterable[int]) -> Panel:
        return self._feature("lag", features=names.as_list(features), lags=[lags] if isinstance(lags, int) else list(lags))

    def difference_features(self, features: str | Iterable[str], periods: int = 1) -> Panel:
        return self._feature("difference", features=names.as_list(features), periods=periods)

    def calc_statistical_features(self, features: str | Iterable[str], **arguments: Any) -> Panel:
        return self._feature("statistics", features=names.as_list(features), **arguments)

    def calc_ewma(self, features: str | Iterable[str], **arguments: Any) -> Panel:
        return self._feature("ewma", features=names.as_list(features), **arguments)

    def calc_percent_relative_to_threshold(self, features: str | Iterable[str] | None = None, **arguments: Any) -> Panel:
        return self._feature("threshold", features=names.as_list(features) or [self.target], **arguments)

    def calc_percent_change(self, feature: str | None = None, **arguments: Any) -> Panel:
        return self._feature("percent_change", feature=feature or self.target, **arguments)

    def calc_days_since_release(self, ignore_leading_zeroes: bool = True) -> Panel:
        return self._feature("days_since_release", ignore_leading_zeroes=ignore_leading_zeroes)

    def calc_datetime_features(self, datetime_list: str | Iterable[str]) -> Panel:
        return self._feature("datetime", parts=names.as_list(datetime_list))

    # Forecasting

    def _coded(self) -> Panel:
        """Text columns, keys too, as codes: what models can read, so that a series' key is a feature.
        What comes out of a model is decoded again."""
        columns = [f.name for f in self.frame.schema if isinstance(f.dataType, T.StringType)]
        if not columns:
            return self
        frame, codes = transforms.encode_categoricals(self.frame, columns)
        return replace(self, frame=frame, codes={**self.codes, **codes})

    def make_future(self, periods: int, freq: str = "1 day", include_history: bool = True, fitted: Sequence = (), min_lag_dict: Mapping[str, int] | None = None) -> DataFrame:
        """History, if wanted, and the next times of every series, scaled and with all features."""
        frame = split.future_frame(self.frame, self.time, self.keys, self.target, periods, freq).withColumn("__new", F.lit(True))
        old = F.max(self.time)
        last = self.frame.agg(old.alias("__last"))
        frame = frame.join(F.broadcast(last), F.lit(True)).withColumn("__new", F.col(self.time) > F.col("__last")).drop("__last")
        out = replay(transforms.apply_scalers(frame, fitted), self.specs, self.context, dict(min_lag_dict or {}))
        return (out if include_history else out.where("__new")).drop("__new")

    def predict(self, model: str = "gbt", future_periods: int | None = None, min_lag_dict: Mapping[str, int] | None = None, freq: str = "1 day", quantile: float = 0.5, **params: Any) -> Panel:
        """Fits on the whole panel and forecasts its rows, and the future if asked; features of future
        rows beyond their lags are missing, as forecasts are never fed back."""
        own = self._coded()
        scaled, fitted = fit_scalers(own.frame, own.scalers)
        engineered = replay(scaled, own.specs, own.context, dict(min_lag_dict or {}))
        made = models.fit(engineered, own.time, own.keys, own.target, model, quantile, **params)
        rows = own.make_future(future_periods, freq, True, fitted, min_lag_dict) if future_periods else engineered
        name = f"predicted_{own.target}"
        out = made.predict(rows, name)
        out = out.withColumns({c: transforms.undo_on(F.col(c), own.target, fitted) for c in (name, f"{name}_lower", f"{name}_upper", "trend") if c in out.columns and (c != "trend" or made.spread is not None)})
        out = relational.merge_actuals(out.drop(own.target), own.frame, own.time, own.keys, own.target)
        return replace(self, predictions=out, model=made, codes=own.codes)

    def get_predictions(self, append_hierarchy_col: bool = False, full_output: bool = False, floor: float | None = None) -> DataFrame:
        """Time, target, forecast and keys, decoded; all columns if full_output."""
        if self.predictions is None:
            raise ValueError("there are no predictions yet")
        out = transforms.decode_categoricals(self.predictions, self.codes)
        if floor is not None:
            out = transforms.set_forecast_minimum(out, floor)
        if append_hierarchy_col:
            out = relational.hierarchy_column(out, self.keys)
        if full_output:
            return out
        name = f"predicted_{self.target}"
        more = [c for c in ("trend", f"{name}_upper", f"{name}_lower") if c in out.columns and self.model is not None and self.model.spread is not None]
        return out.select(self.time, self.target, name, *more, *self.keys, *(["hierarchy"] if append_hierarchy_col else []))

    def fold_frame(self, bounds: split.Bounds, unit: str = "date", min_lag_dict: Mapping[str, int] | None = None) -> tuple[DataFrame, list]:
        """A fold's rows with __train: scalers are fitted on train only, and features see train values but
        no test value; the target of both is scaled."""
        ranked, _ = split.positioned(self.frame, self.time, self.keys, unit)
        p = F.col("__position")
        used = ranked.where((p < bounds.train_end) | ((p >= bounds.test_start) & (p < bounds.test_end)))
        used = used.withColumn("__train", p < bounds.train_end).drop("__position")
        _, fitted = fit_scalers(used.where("__train"), self.scalers)
        frame = split.masked(transforms.apply_scalers(used, fitted), self.target, F.col("__train"))
        engineered = replay(frame, self.specs, self.context, dict(min_lag_dict or {}))
        return engineered.withColumn(self.target, F.col("__actual")).drop("__actual"), fitted

    def fold_data(self, bounds: split.Bounds, unit: str = "date", min_lag_dict: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame, list]:
        """Train and test of a fold, and its scalers."""
        frame, fitted = self.fold_frame(bounds, unit, min_lag_dict)
        return frame.where("__train").drop("__train"), frame.where("not __train").drop("__train"), fitted

    def cross_validate(
        self, model: str = "gbt", future_periods: int | None = None, params: Mapping[str, Sequence[Any]] | str | None = None, folds: int = 5, gap: int = 0, min_lag_dict: Mapping[str, int] | None = None,
        search_strategy: str = "random", n_iter: int = 10, unit: str = "date", parallelism: int = 2, quantile: float = 0.5, splitter: int | str = 3,
    ) -> Panel:
        """Rolling-origin folds, each with its own search, then a forecast with the last fold's choice.

        A fold's search compares choices over `splitter` folds of whole dates, or one for each date
        ("each")."""
        own = self._coded()
        _, n = split.positioned(own.frame, own.time, own.keys, unit)
        grid = models.get_params(model, params if isinstance(params, str) else "light") if params is None or isinstance(params, str) else dict(params)
        name = f"predicted_{own.target}"

        def one(bounds: split.Bounds) -> Fold:
            frame, fitted = own.fold_frame(bounds, unit, min_lag_dict)
            frame = frame.persist()  # search, fit and both forecasts read it
            train, test = frame.where("__train").drop("__train"), frame.where("not __train").drop("__train")
            try:
                best, error = models.search(train, own.time, own.keys, own.target, model, grid, search_strategy, n_iter, splitter, quantile)
                made = models.fit(train, own.time, own.keys, own.target, model, quantile, **best)
            finally:
                frame.unpersist()
            undo = {c: transforms.undo_on(F.col(c), own.target, fitted) for c in (own.target, name)}
            return Fold(bounds.fold, made.predict(train, name).withColumns(undo), made.predict(test, name).withColumns(undo), best, error)

        with ThreadPoolExecutor(parallelism) as pool:
            found = tuple(pool.map(one, split.fold_bounds(n, folds, gap)))
        done = self.predict(model, future_periods, min_lag_dict, quantile=quantile, **found[-1].params)
        return replace(done, folds=found)

    def fold_predictions(self) -> DataFrame:
        """All folds' forecasts with fold and sample, keys decoded."""
        parts = [df.select(self.time, *self.keys, self.target, f"predicted_{self.target}").withColumns({"fold": F.lit(f.number), "sample": F.lit(s)}) for f in self.folds for s, df in (("train", f.train), ("test", f.test))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return transforms.decode_categoricals(out, {c: t for c, t in self.codes.items() if c in self.keys})

    # Interpretation

    def get_errors(self, describe: bool = True) -> DataFrame:
        """Errors of the last fold's test rows, or else of the predictions."""
        rows = self.folds[-1].test if self.folds else self.predictions
        if rows is None:
            raise ValueError("there are no predictions yet")
        errors = summaries.row_errors(rows, self.target, f"predicted_{self.target}")
        return summaries.described(errors) if describe else errors

    def get_cross_validation_errors(self, describe: bool = True) -> DataFrame:
        rows = self.fold_predictions()
        name = f"predicted_{self.target}"
        return summaries.fold_errors(rows, self.target, name) if describe else summaries.row_errors(rows, self.target, name)

    def summarize_cv(self) -> dict[str, Any]:
        errors = summaries.row_errors(self.fold_predictions(), self.target, f"predicted_{self.target}").cache()
        try:
            last = max(f.number for f in self.folds)
            medians, weighted = ({r["sample"]: r["value"] for r in summaries.summarised(errors, how, last).collect()} for how in ("median", "weighted"))
            return summaries.summarize_cv(medians, weighted)
        finally:
            errors.unpersist()

    def importances(self) -> DataFrame:
        """The model's own measure; not comparable with Shapley values."""
        if self.model is None:
            raise ValueError("there is no model yet")
        return self.model.importances(self.frame.sparkSession)

    def summarize_importances(self) -> dict[str, Any]:
        return summaries.summarize_importances([(r["feature"], r["importance"]) for r in self.importances().collect()])
