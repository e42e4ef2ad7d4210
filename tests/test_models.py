import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewise.operators import models, summaries
from tidewise.sources.panel import Panel


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, dt.datetime(2021, 1, 1) + dt.timedelta(d), 50.0 + 10 * (k == "b") + 5 * math.sin(d * 2 * math.pi / 7) + d * 0.1, "x" if d % 2 else "y") for k in "ab" for d in range(80)]
    frame = spark.createDataFrame(rows, "k string, t timestamp, y double, tag string").repartition(3)
    return Panel.create(frame, "t", "y", "k").standardize_features("y").lag_features("y", [7, 14]).calc_datetime_features(["day_of_week"])


def test_predict_history_and_future(panel):
    done = panel.predict("gbt", future_periods=5, maxIter=8, maxDepth=4)
    out = done.get_predictions(append_hierarchy_col=True, floor=0)
    assert out.count() == 170 and out.columns == ["t", "y", "predicted_y", "k", "hierarchy"]
    assert out.where("y is null").count() == 10 and {r[0] for r in out.select("k").distinct().collect()} == {"a", "b"}
    error = out.where("y is not null").agg(F.avg(F.abs(F.col("y") - F.col("predicted_y")))).first()[0]
    assert error < 3  # forecasts are on the target's own scale
    assert done.get_predictions(full_output=True).where("tag is not null").select("tag").distinct().count() == 2
    assert done.importances().count() > 4 and len(done.summarize_importances()["top"]) == 4
    assert done.get_errors().count() == 5


def test_cross_validation(panel):
    done = panel.cross_validate("gbt", folds=2, params={"maxIter": [3], "maxDepth": [2, 4]}, n_iter=2)
    errors = done.get_cross_validation_errors()
    assert errors.count() == 4 and {r["n"] for r in errors.where("sample = 'test'").collect()} == {52}
    summary = done.summarize_cv()
    assert summary["score"] in ("best", "good", "bad", "worst") and summary["fit"] and "off by less" in summary["performance"]
    assert done.predictions is not None and set(done.folds[-1].params) == {"maxIter", "maxDepth"}


def test_trend_seasonal_and_unknown_models(panel):
    out = panel.predict("trend_seasonal", future_periods=2).get_predictions()
    assert out.where("predicted_y is null").count() == 0
    with pytest.raises(ValueError):
        models.estimator("median", quantile=0.9)
    with pytest.raises(ValueError):
        models.estimator("forest")
    assert len(models.candidates(models.get_params("gbt", "full"))) == 10


def test_summary_levels():
    assert summaries.level(1.7) == "worst" and summaries.level(0.1) == "best" and summaries.level(None) is None
    over = summaries.summarize_cv({"train": 0.02, "test": 0.4}, {"test": 0.5})
    assert over["score"] == "worst" and over["recommendation"] == summaries.OVERFIT
