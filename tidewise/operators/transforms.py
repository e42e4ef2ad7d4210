"""Panel preparation: negatives, gaps, fills, codes, types and invertible scalers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.windows import series
from .features import joined_back, require


def correct_negatives(df: DataFrame, features: Iterable[str] | str, replace_value: float = 0) -> DataFrame:
    """Values below 0 become replace_value; nulls stay."""
    features = names.as_list(features)
    require(df, features)
    return df.withColumns({f: F.when(F.col(f) < 0, F.lit(replace_value).cast(df.schema[f].dataType)).otherwise(F.col(f)) for f in features})


def set_forecast_minimum(df: DataFrame, floor: float = 0) -> DataFrame:
    """Every predicted_ column that is not above the floor, null included, becomes the floor."""
    return df.withColumns({c: F.when(F.col(c) > floor, F.col(c)).otherwise(F.lit(float(floor))) for c in df.columns if c.startswith("predicted_")})


def fill_time_gaps(df: DataFrame, time: str, keys: Sequence[str], per_series: bool = False, fill_value: float | None = None, freq: str = "1 day") -> DataFrame:
    """A row for every step from the panel's (or each series') first to last time; measures of new rows
    are null, or fill_value."""
    measures = [c for c in df.columns if c not in (*keys, time)]
    low, high = F.min(time).alias("__low"), F.max(time).alias("__high")
    if per_series and keys:
        spans = df.groupBy(*keys).agg(low, high)
    else:
        spans = df.select(*keys).distinct() if keys else df.select(F.lit(1).alias("__one")).limit(1)
        spans = spans.join(F.broadcast(df.agg(low, high)), F.lit(True))  # one row
    spine = spans.select(*keys, F.explode(F.sequence("__low", "__high", F.expr(f"interval {freq}"))).alias(time))
    spine = spine.withColumn(time, F.col(time).cast(df.schema[time].dataType))
    out = joined_back(spine, df if fill_value is None else df.withColumn("__there", F.lit(True)), [*keys, time])
    if fill_value is not None:
        numeric = [m for m in measures if isinstance(df.schema[m].dataType, T.NumericType)]
        out = out.withColumns({m: F.when(F.col("__there").isNull(), F.lit(fill_value).cast(df.schema[m].dataType)).otherwise(F.col(m)) for m in numeric}).drop("__there")
    return out.select(*df.columns)


def fill_missings(df: DataFrame, time: str, keys: Sequence[str], method: str = "ffill", features: Iterable[str] | str | None = None) -> DataFrame:
    """The last value before a null, or the first after it, within a series; all measures by default."""
    if method not in ("ffill", "bfill"):
        raise ValueError("method must be ffill or bfill")
    features = names.as_list(features) or [c for c in df.columns if c not in (*keys, time)]
    require(df, features)
    w = series(df, time, keys)
    if method == "ffill":
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in features})
    w = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({f: F.first(f, ignorenulls=True).over(w) for f in features})


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): codes count the sorted distinct labels from 0.  One row per label."""
    labels = df.select(F.col(column).alias("label")).where(F.col("label").isNotNull()).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("code"))


def encode_categoricals(df: DataFrame, columns: Iterable[str] | None = None, codes: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """String columns as codes, null as -1, and the dictionary of each."""
    columns = names.as_list(columns) if columns is not None else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    require(df, columns)
    codes = dict(codes or {c: category_codes(df, c) for c in columns})
    order = df.columns
    for c in columns:
        right = codes[c].select(F.col("label").alias("__label"), F.col("code").alias("__code"))
        df = df.join(right, F.col(c) == F.col("__label"), "left").withColumn(c, F.coalesce("__code", F.lit(-1))).drop("__label", "__code").select(*order)
    return df, codes


def decode_categoricals(df: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    """The labels of coded columns; -1 is null."""
    order = df.columns
    for c, table in codes.items():
        if c in order:
            right = table.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
            df = df.join(right, F.col(c) == F.col("__code"), "left").withColumn(c, F.col("__label")).drop("__label", "__code").select(*order)
    return df


def compress(df: DataFrame, floats: bool = False) -> DataFrame:
    """Integer columns in the smallest type that holds them; doubles as floats only if asked, as that
    loses digits."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    if whole:
        ends = df.agg(*(F.min(c).alias(f"l_{c}") for c in whole), *(F.max(c).alias(f"h_{c}") for c in whole)).first()
        new = {}
        for c in whole:
            low, high = ends[f"l_{c}"] or 0, ends[f"h_{c}"] or 0
            kind = next(k for k, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**b) <= low and high < 2**b)
            new[c] = F.col(c).cast(kind)
        df = df.withColumns(new)
    if floats:
        df = df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})
    return df


# Scalers: parameters are plain numbers by feature, so that a fit on train applies to test.

KINDS = ("log1p", "standardize", "normalize")


def fit_scaler(df: DataFrame, kind: str, features: Iterable[str], given: Mapping[str, Mapping[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """feature -> parameters, from one aggregate over df; given ones are not computed."""
    features = names.as_list(features)
    require(df, features)
    found = {f: dict((given or {}).get(f, {})) for f in features}
    open_ = [f for f in features if not found[f]]
    if kind == "log1p":
        low = df.agg(*(F.min(f).alias(f) for f in features)).first()
        if any(low[f] is not None and low[f] < 0 for f in features):
            raise ValueError("log1p needs values of at least 0")
    elif kind == "standardize" and open_:
        row = df.agg(*(F.avg(f).alias(f"m_{f}") for f in open_), *(F.stddev_samp(f).alias(f"s_{f}") for f in open_)).first()
        found |= {f: {"mean": row[f"m_{f}"], "stdev": row[f"s_{f}"]} for f in open_}
    elif kind == "normalize" and open_:
        row = df.agg(*(F.max(f).alias(f"h_{f}") for f in open_), *(F.min(f).alias(f"l_{f}") for f in open_)).first()
        found |= {f: {"max": None if row[f"h_{f}"] is None else float(row[f"h_{f}"]), "min": None if row[f"l_{f}"] is None else float(row[f"l_{f}"])} for f in open_}
    elif kind not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}; there are {KINDS}")
    return found


def scaled(x: Column, kind: str, p: Mapping[str, float]) -> Column:
    x = x.cast("double")
    if kind == "log1p":
        return F.log1p(x)
    if kind == "standardize":
        return F.try_divide(x - F.lit(p["mean"]), F.lit(p["stdev"]))
    return F.try_divide(x - F.lit(p["min"]), F.lit(p["max"]) - F.lit(p["min"]))


def unscaled(x: Column, kind: str, p: Mapping[str, float]) -> Column:
    x = x.cast("double")
    if kind == "log1p":
        return F.expm1(x)
    if kind == "standardize":
        return x * F.lit(p["stdev"]) + F.lit(p["mean"])
    return x * (F.lit(p["max"]) - F.lit(p["min"])) + F.lit(p["min"])


#: Fitted scalers in the order in which they were applied.
Fitted = Sequence[tuple[str, Mapping[str, Mapping[str, float]]]]


def apply_scalers(df: DataFrame, fitted: Fitted) -> DataFrame:
    for kind, by in fitted:
        df = df.withColumns({f: scaled(F.col(f), kind, p) for f, p in by.items() if f in df.columns})
    return df


def undo_scalers(df: DataFrame, fitted: Fitted) -> DataFrame:
    for kind, by in reversed(list(fitted)):
        df = df.withColumns({f: unscaled(F.col(f), kind, p) for f, p in by.items() if f in df.columns})
    return df


def undo_on(x: Column, feature: str, fitted: Fitted) -> Column:
    """Undoes what was done to `feature`, on another column such as its forecast."""
    for kind, by in reversed(list(fitted)):
        if feature in by:
            x = unscaled(x, kind, by[feature])
    return x
