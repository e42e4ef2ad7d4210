"""Save and load with folds, quantile models, intervals and components, row folds, inner folds for each date."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewise.operators import features as ops
from tidewise.operators import models, split, transforms
from tidewise.sources.panel import Panel


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    rows = [(k, dt.datetime(2021, 1, 1) + dt.timedelta(d), 50.0 + 10 * (k == "b") + 5 * math.sin(d * 2 * math.pi / 7) + d * 0.1 + rng.gauss(0, 2)) for k in "ab" for d in range(90)]
    return Panel.create(spark.createDataFrame(rows, "k string, t timestamp, y double").repartition(3), "t", "y", "k").standardize_features("y").lag_features("y", [7, 14])


def test_folds_survive_saving(panel, spark, tmp_path):
    done = panel.cross_validate("gbt", folds=2, params={"maxIter": [3], "maxDepth": [2]}, parallelism=1)
    done.save(str(tmp_path / "p"))
    again = Panel.load(spark, str(tmp_path / "p"))
    assert again.get_errors().collect() == done.get_errors().collect()
    assert sorted(map(tuple, again.get_cross_validation_errors(describe=False).select("t", "k", "fold", "sample").collect())) == sorted(map(tuple, done.get_cross_validation_errors(describe=False).select("t", "k", "fold", "sample").collect()))
    assert {r[0] for r in again.fold_predictions().select("k").distinct().collect()} == {"a", "b"}  # keys are decoded
    assert [(f.number, f.params) for f in again.folds] == [(f.number, f.params) for f in done.folds]
    assert again.specs == panel.specs and again.scalers == panel.scalers


def test_quantile_models_cover_their_share(panel, spark, tmp_path):
    for q in (0.1, 0.9):
        done = panel.predict("quantile", quantile=q, maxIter=10, maxDepth=3)
        below = done.predictions.where("y is not null").agg(F.avg((F.col("y") <= F.col("predicted_y")).cast("int"))).first()[0]
        assert abs(below - q) < 0.08
    done.save(str(tmp_path / "q"))
    again = Panel.load(spark, str(tmp_path / "q")).model
    frame = done.frame.withColumn("k", F.lit(0)).withColumns({"y_lag7": F.lit(0.1), "y_lag14": F.lit(0.2)})
    assert again.shifts == done.model.shifts and again.predict(frame, "p").agg(F.sum("p")).first() == done.model.predict(frame, "p").agg(F.sum("p")).first()
    with pytest.raises(ValueError):
        panel.predict("quantile", quantile=1.5)


def test_seasonal_intervals_and_components(panel):
    out = panel.predict("trend_seasonal", future_periods=4).get_predictions()
    assert out.columns == ["t", "y", "predicted_y", "trend", "predicted_y_upper", "predicted_y_lower", "k"]
    rows = out.collect()
    assert all(r.predicted_y_lower < r.predicted_y < r.predicted_y_upper for r in rows)
    inside = [r.predicted_y_lower <= r.y <= r.predicted_y_upper for r in rows if r.y is not None]
    assert 0.7 < sum(inside) / len(inside) < 0.95


def test_blending(spark):
    assert models.quantile_weights()[0.5] == 1.0 and sum(models.quantile_weights((0.1, 0.9), (1, 2)).values()) == 3
    out = models.blended(spark.createDataFrame([(1.0, 4.0), (None, 4.0), (None, None)], "a double, b double"), {0.1: "a", 0.9: "b"}, "c", {0.1: 1.0, 0.9: 2.0})
    assert [r.c for r in out.collect()] == [3.0, 4.0, None]
    with pytest.raises(ValueError):
        models.quantile_weights((2.0,), (1.0,))


def test_positions_of_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcdefgh") + str(i), dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(20)), i) for i in range(300)]
    out, n = split.positioned(spark.createDataFrame(rows, "k string, t date, v int").repartition(7), "t", ["k"], "row")
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert n == 300 and {r.v: r["__position"] for r in out.collect()} == want


def test_inner_folds_for_each_date(spark):
    rows = [("a", dt.datetime(2021, 1, 1) + dt.timedelta(d), float(d % 3), float(d % 3)) for d in range(6)]
    frame = spark.createDataFrame(rows, "k string, t timestamp, y double, x double")
    best, error = models.search(frame.drop("k"), "t", [], "y", "gbt", {"maxIter": [1, 3], "maxDepth": [1]}, "grid", inner_folds="each")
    assert best["maxDepth"] == 1 and error is not None


def test_smoothing_over_many_blocks(spark):
    import pandas as pd

    rng = random.Random(9)
    values = [None if rng.random() < 0.3 else rng.gauss(0, 10 ** rng.randint(-3, 6)) for _ in range(700)]
    values[100:400] = [None] * 300  # longer than two blocks of the short span
    frame = spark.createDataFrame([("a", dt.datetime(2020, 1, 1) + dt.timedelta(d), v) for d, v in enumerate(values)], "k string, t timestamp, x double").repartition(4)
    out = ops.calc_ewma(frame, "t", ["k"], "x", [3, 9, 40], lag=0, min_periods=1).orderBy("t").collect()
    for span in (3, 9, 40):
        want = pd.Series(values, dtype=float).ewm(span=span, min_periods=1).mean()
        for r, w in zip(out, want, strict=True):
            got = r[f"x_ewma_roll{span}"]
            assert got is None and math.isnan(w) or math.isclose(got, w, rel_tol=1e-6, abs_tol=1e-6), (span, r)


def test_gaps_filled_with_a_value_keep_missing_ones(spark):
    rows = [("a", dt.date(2020, 1, 1), None), ("a", dt.date(2020, 1, 3), 2.0), ("b", dt.date(2020, 1, 2), 1.0)]
    out = transforms.fill_time_gaps(spark.createDataFrame(rows, "k string, t date, v double"), "t", ["k"], fill_value=0.0)
    assert sorted((r.k, r.t.day, r.v) for r in out.where("v is not null").collect()) == [("a", 2, 0.0), ("a", 3, 2.0), ("b", 1, 0.0), ("b", 2, 1.0), ("b", 3, 0.0)]
    assert out.where("v is null").count() == 1 and out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
