"""Recorded pipelines: immutable specs that replay on any frame of the panel's columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..functions.windows import US, with_us
from ..operators import features as ops
from ..operators import transforms
from ..operators.relational import drop_short_lags


@dataclass(frozen=True)
class Context:
    """What a spec needs to know about the panel it is applied to."""

    time: str
    keys: tuple[str, ...]
    target: str


OPERATORS = {
    "lag": lambda df, c, **a: ops.lag_features(df, c.time, c.keys, target=c.target, **a),
    "difference": lambda df, c, **a: ops.difference_features(df, c.time, c.keys, **a),
    "statistics": lambda df, c, **a: ops.calc_statistical_features(df, c.time, c.keys, **a),
    "ewma": lambda df, c, **a: ops.calc_ewma(df, c.time, c.keys, **a),
    "threshold": lambda df, c, **a: ops.calc_percent_relative_to_threshold(df, c.time, c.keys, **a),
    "percent_change": lambda df, c, **a: ops.calc_percent_change(df, c.time, c.keys, **a),
    "days_since_release": lambda df, c, **a: ops.calc_days_since_release(df, c.time, c.keys, c.target, **a),
    "datetime": lambda df, c, **a: ops.calc_datetime_features(df, c.time, **a),
}


def frozen(value: Any) -> Any:
    """Lists as tuples and dicts as sorted pairs, so that a spec can't change after it is recorded."""
    if isinstance(value, dict):
        return ("dict", tuple(sorted((k, frozen(v)) for k, v in value.items())))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(frozen(v) for v in value))
    return value


def thawed(value: Any) -> Any:
    if isinstance(value, (list, tuple)) and len(value) == 2 and value[0] == "dict":
        return {k: thawed(v) for k, v in value[1]}
    if isinstance(value, (list, tuple)) and len(value) == 2 and value[0] == "list":
        return [thawed(v) for v in value[1]]
    return value


@dataclass(frozen=True)
class Spec:
    """An operator's name and its arguments."""

    operator: str
    arguments: Any

    @classmethod
    def of(cls, operator: str, **arguments: Any) -> Spec:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator!r}")
        return cls(operator, frozen(arguments))

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return OPERATORS[self.operator](df, context, **thawed(self.arguments))

    def to_json(self) -> str:
        return json.dumps([self.operator, self.arguments])

    @classmethod
    def from_json(cls, text: str) -> Spec:
        operator, arguments = json.loads(text)
        return cls(operator, frozen(thawed(arguments)))


@dataclass(frozen=True)
class ScalerSpec:
    """A scaler kind, its features, and parameters that are given rather than fitted."""

    kind: str
    features: tuple[str, ...]
    given: Any = None

    def fit(self, df: DataFrame) -> tuple[str, dict[str, dict[str, float]]]:
        return self.kind, transforms.fit_scaler(df, self.kind, self.features, thawed(self.given) if self.given else None)


def replay(df: DataFrame, specs: Sequence[Spec], context: Context, min_lags: dict[str, int] | None = None) -> DataFrame:
    """All recorded features on df, less the lags that are too short."""
    df = with_us(df, context.time)
    for spec in specs:
        df = spec.apply(df, context)
    return drop_short_lags(df.drop(US), min_lags, context.target)


def fit_scalers(df: DataFrame, scalers: Sequence[ScalerSpec]) -> tuple[DataFrame, list]:
    """df scaled, and the fitted parameters in order; each scaler is fitted on what the one before left."""
    fitted = []
    for scaler in scalers:
        found = scaler.fit(df)
        df = transforms.apply_scalers(df, [found])
        fitted.append(found)
    return df, fitted
