"""Operators against hand-computed goldens on a micro-panel with a gap, nulls, a zero and negatives."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewise.functions import calendar, names
from tidewise.operators import features as ops
from tidewise.operators import relational, split, transforms
from tidewise.sources.panel import Panel

N = None
KEYS = ["category", "product", "state", "store"]
S3 = [("2020-01-01", 113.0, 113.21), ("2020-01-02", 10000.0, 10000.0), ("2020-01-03", 214.0, N), ("2020-01-05", 123.0, 123.21)]
S4 = [("2019-12-30", 5.0, 5.1), ("2019-12-31", N, N), ("2020-01-01", 0.0, 0.0), ("2020-01-02", -20.0, -20.1)]
S5 = [("2019-12-30", 2.0, 2.1), ("2019-12-31", 4.0, 4.1), ("2020-01-01", 10.0, 10.2), ("2020-01-02", -10.0, -10.1)]
WHO = [("Cat_1", "Prod_3"), ("Cat_2", "Prod_4"), ("Cat_2", "Prod_5")]
SCHEMA = "datetime string, category string, product string, state string, store string, sales_int double, sales_float double"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(d, c, p, "CA", "Store_1", i, f) for (c, p), s in zip(WHO, (S3, S4, S5), strict=True) for d, i, f in s]
    return spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def df(raw):
    return raw.withColumn("datetime", F.to_timestamp("datetime"))


def column(df, name):
    """Values by series and time: the order of the goldens."""
    return [r[name] for r in df.orderBy("product", "datetime").select(name).collect()]


def same(got, want):
    assert len(got) == len(want), (got, want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or g == w or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-9)), (got, want)


def test_days_since_release(df):
    same(column(ops.calc_days_since_release(df, "datetime", KEYS, "sales_int"), "days_since_release"), [0, 1, 2, 4, 0, 1, 2, 3, 0, 1, 2, 3])


def test_lags_and_differences(df):
    out = ops.lag_features(df, "datetime", KEYS, "sales_int", [1, 3], "sales_int")
    same(column(out, "sales_int_lag1"), [N, 113, 10000, 214, N, 5, N, 0, N, 2, 4, 10])
    same(column(out, "sales_int_lag3"), [N, N, N, 113, N, N, N, 5, N, N, N, 2])
    same(column(ops.difference_features(df, "datetime", KEYS, "sales_int"), "sales_int_differenced_1"), [N, 9887, -9786, -91, N, N, N, -20, N, 2, 6, -20])
    with pytest.raises(ValueError):
        ops.lag_features(df, "datetime", KEYS, "sales_int", 0)
    with pytest.raises(ValueError):
        ops.lag_features(df, "datetime", KEYS, "nothing", 1)


def test_rolling_means_momentum_and_share(df):
    out = ops.calc_statistical_features(df, "datetime", KEYS, "sales_float", [2, 4], ["mean", "sum"], momentums=True, percentages=True)
    same(column(out, "sales_float_mean_roll2_lag1"), [N, 113.21, 5056.605, N, N, 5.1, 5.1, 0, N, 2.1, 3.1, 7.15])
    same(column(out, "sales_float_mean_roll4_lag1"), [N, 113.21, 5056.605, 5056.605, N, 5.1, 5.1, 2.55, N, 2.1, 3.1, 16.4 / 3])
    same(column(out, "sales_float_mean_roll2_lag1_momentum"), [N, 1, 10000 / 5056.605, N, N, 1, N, N, N, 1, 4.1 / 3.1, 10.2 / 7.15])
    same(column(out, "sales_float_sum_roll2_lag1_perc"), [N, 1, 10000 / 10113.21, N, N, 1, N, N, N, 1, 4.1 / 6.2, 10.2 / 14.3])


def test_groupers(df):
    groupers = {"name": "across_products", "columns": ["store", "state", "category"], "operation": "sum"}
    out = ops.calc_statistical_features(df, "datetime", KEYS, "sales_float", [2, 4], ["sum"], groupers=groupers)
    two, four = [N, 7.2, 11.3, 14.3], [N, 7.2, 11.3, 21.5]
    same(column(out, "sales_float_sum_across_products_roll2_lag1"), [N, 113.21, 10113.21, 0, *two, *two])
    same(column(out, "sales_float_sum_across_products_roll4_lag1"), [N, 113.21, 10113.21, 10113.21, *four, *four])


@pytest.mark.parametrize("adjust_by_pandas", [False, True])
def test_ewma(df, adjust_by_pandas, monkeypatch):
    if adjust_by_pandas:
        monkeypatch.setattr(ops, "LONG_SPAN", 1)
    out = ops.calc_ewma(df, "datetime", KEYS, "sales_float", [4, 2], min_periods=1, crossovers=True)
    two = [N, 113.21, 7528.3025, 7528.3025, N, 5.1, 5.1, 0.51, N, 2.1, 3.1 + 1 / 3 + 1 / 6, 8.169230769]
    four = [N, 113.21, 6292.45375, 6292.45375, N, 5.1, 5.1, 1.35, N, 2.1, 3.35, 6.844897959]
    got2, got4 = column(out, "sales_float_ewma_roll2_lag1"), column(out, "sales_float_ewma_roll4_lag1")
    for got, want in ((got2, two), (got4, four)):
        assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-6) for g, w in zip(got, want, strict=True)), got
    same(column(out, "sales_float_ewma_roll2_lag1_cross4"), [None if b is None else a / b for a, b in zip(got2, got4, strict=True)])


def test_ewma_matches_pandas_and_its_edges(spark):
    import pandas as pd

    values = [3.0, None, 4.0, None, None, 8.0, 1.0]
    rows = [("a", dt.datetime(2020, 1, 1 + i), v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, t timestamp, x double")
    for span in (1, 5):
        out = ops.calc_ewma(frame, "t", ["k"], "x", [span], lag=0, min_periods=1).orderBy("t")
        want = pd.Series(values, dtype="float64").ewm(span=span).mean().ffill()
        same([r[0] for r in out.select(f"x_ewma_roll{span}").collect()], want.tolist())


def test_threshold_share(df):
    out = ops.calc_percent_relative_to_threshold(df, "datetime", KEYS, "sales_int", [2, 4])
    same(column(out, "sales_int_perc_greater0_roll2_lag1"), [N, 1, 1, 1, N, 1, 0.5, 0, N, 1, 1, 1])
    same(column(out, "sales_int_perc_greater0_roll4_lag1"), [N, 1, 1, 1, N, 1, 0.5, 1 / 3, N, 1, 1, 1])


def test_percent_change(df):
    same(column(ops.calc_percent_change(df, "datetime", KEYS, "sales_int"), "sales_int_pct_change_lag1"), [N, N, 9887 / 113, -9786 / 10000, N, N, N, N, N, N, 1, 1.5])


def test_calendar(df):
    out = ops.calc_datetime_features(df, "datetime", list(calendar.PARTS))
    late = [53, 53, 1, 1]
    assert column(out, "week") == [1, 1, 1, 2, *late, *late]
    assert column(out, "day_of_week") == [2, 3, 4, 6, *[0, 1, 2, 3] * 2]
    assert column(out, "weekend_flag") == [False] * 3 + [True] + [False] * 8
    assert column(out, "month_year")[:5] == ["20M01"] * 4 + ["19M12"] and column(out, "quarter_year")[4] == "19Q4" and column(out, "year")[3:5] == [20, 19]
    with pytest.raises(ValueError):
        ops.calc_datetime_features(df, "datetime", "century")


def test_fills_and_gaps(df):
    full = transforms.fill_time_gaps(df, "datetime", KEYS)
    days = [dt.datetime(2019, 12, 30) + dt.timedelta(i) for i in range(7)]
    assert column(full, "datetime") == days * 3
    same(column(full, "sales_int")[:7], [N, N, 113, 10000, 214, N, 123])
    same(column(transforms.fill_time_gaps(df, "datetime", KEYS, fill_value=0), "sales_float")[:7], [0, 0, 113.21, 10000, N, 0, 123.21])
    assert transforms.fill_time_gaps(df, "datetime", KEYS, per_series=True).count() == 5 + 4 + 4
    assert column(transforms.fill_missings(df, "datetime", KEYS, "ffill"), "sales_float")[2::3][0] == 10000
    same(column(transforms.fill_missings(df, "datetime", KEYS, "ffill", "sales_float"), "sales_float"), [113.21, 10000, 10000, 123.21, 5.1, 5.1, 0, -20.1, 2.1, 4.1, 10.2, -10.1])
    same(column(transforms.fill_missings(df, "datetime", KEYS, "bfill", ["sales_float"]), "sales_float"), [113.21, 10000, 123.21, 123.21, 5.1, 0, 0, -20.1, 2.1, 4.1, 10.2, -10.1])


def test_negatives_codes_and_types(df):
    same(column(transforms.correct_negatives(df, "sales_int"), "sales_int"), [113, 10000, 214, 123, 5, N, 0, 0, 2, 4, 10, 0])
    coded, codes = transforms.encode_categoricals(df)
    assert [column(coded, c) for c in KEYS] == [[0] * 4 + [1] * 8, [0] * 4 + [1] * 4 + [2] * 4, [0] * 12, [0] * 12]
    back = transforms.decode_categoricals(coded, codes)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    small = transforms.compress(df.select(F.lit(3).cast("long").alias("a"), F.lit(40000).cast("long").alias("b")))
    assert [t for _, t in small.dtypes] == ["tinyint", "int"]


def test_scalers_fit_on_train_and_undo(df):
    positive = transforms.correct_negatives(df, ["sales_int", "sales_float"])
    fitted = [(k, transforms.fit_scaler(positive, k, f)) for k, f in (("log1p", ["sales_int"]), ("standardize", ["sales_int", "sales_float"]))]
    values = [v for v in column(positive, "sales_float") if v is not None]
    mean = sum(values) / len(values)
    dev = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5
    assert math.isclose(fitted[1][1]["sales_float"]["stdev"], dev) and math.isclose(fitted[1][1]["sales_float"]["mean"], mean)
    stacked = fitted[:1] + [("normalize", {"sales_int": {"min": 0.0, "max": 2.0}})]
    same(column(transforms.undo_scalers(transforms.apply_scalers(positive, stacked), stacked), "sales_int"), column(positive, "sales_int"))
    with pytest.raises(ValueError):
        transforms.fit_scaler(df, "log1p", ["sales_int"])


def test_names():
    assert names.too_short_lags(["sales_int", "sales_int_lag1", "sales_int_lag7", "sales_int_mean_roll2_lag1", "x_lag1", "sales_int_mean_roll2_lag7_momentum"], {"sales_int": 6}, "sales_int") == ["sales_int_lag1", "sales_int_mean_roll2_lag1", "sales_int_mean_roll2_lag7_momentum"]
    assert names.containing(["a_b", "c"], "b") == ["a_b"]


def test_masked_fold_sees_no_test_value(df):
    panel = Panel.create(df, "datetime", "sales_int", KEYS).correct_negatives()
    panel = panel.lag_features("sales_int", [1, 2, 7, 14]).calc_statistical_features("sales_int", windows=[2, 4], aggregations=["mean"])
    dates = sorted({r[0] for r in df.select("datetime").collect()})
    cut = dates.index(dt.datetime(2020, 1, 2))
    train, test, _ = panel.fold_data(split.Bounds(0, cut, cut, len(dates)), min_lag_dict=None)
    assert (train.count(), test.count()) == (7, 5)
    same(column(test, "sales_int"), [10000, 214, 123, 0, 0])
    same(column(test, "sales_int_lag1"), [113, N, N, 0, 10])
    same(column(test, "sales_int_lag2"), [N, 113, N, N, 4])
    same(column(test, "sales_int_mean_roll2_lag1"), [113, 113, N, 0, 7])
    _, test, _ = panel.fold_data(split.Bounds(0, cut, cut, len(dates)), min_lag_dict={"sales_int": 6})
    assert [c for c in test.columns if "_lag" in c] == ["sales_int_lag7", "sales_int_lag14"]


def test_scalers_of_a_fold_come_from_train(df):
    panel = Panel.create(df, "datetime", "sales_int", KEYS).correct_negatives(["sales_int", "sales_float"]).log_features("sales_int").normalize_features("sales_float")
    dates = sorted({r[0] for r in df.select("datetime").collect()})
    cut = dates.index(dt.datetime(2020, 1, 2))
    _, test, fitted = panel.fold_data(split.Bounds(0, cut, cut, len(dates)))
    assert dict(fitted)["normalize"]["sales_float"] == {"min": 0.0, "max": 113.21}
    same(column(test, "sales_int"), [math.log1p(v) for v in (10000, 214, 123, 0, 0)])


def test_fold_bounds():
    assert [(b.train_end, b.test_start, b.test_end) for b in split.fold_bounds(10, 3, 1)] == [(3, 4, 6), (5, 6, 8), (7, 8, 10)]
    with pytest.raises(ValueError):
        split.fold_bounds(3, 5)


def test_panel_rules(raw, df):
    panel = Panel.create(raw, "datetime", "sales_int", KEYS)
    assert dict(panel.frame.dtypes)["datetime"] == "timestamp" and panel.get_sample().count() == 12
    with pytest.raises(ValueError):
        Panel.create(raw.union(raw.limit(1)), "datetime", "sales_int", KEYS)
    with pytest.raises(ValueError):
        panel.log_features("sales_int").log_features("sales_int")
    nan = df.withColumn("sales_float", F.when(F.col("sales_float").isNull(), float("nan")).otherwise(F.col("sales_float")))
    same(column(Panel.create(nan, "datetime", "sales_int", KEYS).frame, "sales_float"), column(df, "sales_float"))


def test_one_series_without_keys(df):
    one = df.where("product = 'Prod_5'").drop(*KEYS)
    out = ops.calc_ewma(ops.calc_percent_relative_to_threshold(one, "datetime", [], "sales_int", [2]), "datetime", [], "sales_int", [2, 3], min_periods=1, crossovers=True)
    out = ops.calc_days_since_release(out, "datetime", [], "sales_int")
    assert out.count() == 4 and "sales_int_ewma_roll2_lag1_cross3" in out.columns
    assert transforms.fill_missings(transforms.fill_time_gaps(df.where("product = 'Prod_3'").drop(*KEYS), "datetime", []), "datetime", []).count() == 5


def test_future_and_save(df, spark, tmp_path):
    panel = Panel.create(df, "datetime", "sales_int", KEYS).lag_features("sales_int", 2).standardize_features("sales_float").calc_statistical_features("sales_int", windows=[2], groupers={"name": "g", "columns": ["category"], "operation": "sum"})
    future = panel.make_future(2, include_history=False)
    assert future.count() == 6 and sorted({str(r[0].date()) for r in future.select("datetime").collect()}) == ["2020-01-06", "2020-01-07"]
    panel.save(str(tmp_path / "p"))
    back = Panel.load(spark, str(tmp_path / "p"))
    assert back.specs == panel.specs and back.scalers == panel.scalers and back.keys == panel.keys
    assert back.data().columns == panel.data().columns
    for c in ("sales_float", "sales_int_lag2", "sales_int_mean_g_roll2_lag1"):
        same(column(back.data(), c), column(panel.data(), c))


def test_date_texts(spark):
    for start, step, want in (("1980-01-01", "1 day", "Jan. 1 1980"), ("1980-01-01", "1 month", "Jan. 1980"), ("1980-12-31", "12 months", "1980")):
        times = spark.sql(f"select explode(sequence(timestamp '{start}', timestamp '{start}' + interval '12' year, interval {step})) t").limit(6)
        assert want in {r[0] for r in relational.format_dates(times, "t", "s").select("s").collect()}
