"""The engine's operators on the driver's tables, each with the same query as DuckDB SQL.

Panels: PL is lineitem by return flag, line status and ship date; PO orders by market segment, priority
and date (with gaps); PE events by type and day; ER raw events by user (sub-day times).  Doubles are
rounded to four places on both sides, after a small offset that keeps exact ties apart, as engines
break those differently; times come as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import features as ops
from ..operators import relational, split, summaries, transforms
from ..sources.panel import Panel
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
OFFSET = "0.00000131"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace(", 4)", f" + {OFFSET}, 4)")
        return f

    return register


def rounded(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + float(OFFSET), 4)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


# Panels

PL_KEYS, PO_KEYS, PE_KEYS = ["rf", "ls"], ["seg", "prio"], ["kind"]


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_shipdate").alias("dt"), "l_quantity")
    return rows.groupBy("rf", "ls", "dt").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("prio"), F.col("o_orderdate").alias("dt"), "o_totalprice")
    return orders.join(customer, "o_custkey").groupBy("seg", "prio", "dt").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("amt"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("dt"), "value")
    return events.groupBy("kind", "dt").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


PL = "pl AS (SELECT l_returnflag AS rf, l_linestatus AS ls, l_shipdate AS dt, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ALL)"
PO = "po AS (SELECT c_mktsegment AS seg, o_orderpriority AS prio, o_orderdate AS dt, count(*) AS n, sum(o_totalprice) AS amt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
PE = "pe AS (SELECT event_type AS kind, date_trunc('day', ts) AS dt, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)"
W = "w AS (PARTITION BY rf, ls ORDER BY dt)"
DAY = "strftime(dt, '%Y-%m-%d') AS day"


def shown(df: DataFrame, keys: list[str], *columns: str | Column) -> DataFrame:
    """keys, day and the columns, doubles rounded."""
    kinds = dict(df.dtypes)

    def neat(c: str | Column) -> Column | str:
        return rounded(c).alias(c) if isinstance(c, str) and kinds[c] == "double" else c

    return df.select(*keys, F.date_format("dt", "yyyy-MM-dd").alias("day"), *map(neat, columns))


def rolling_sql(expression: str, name: str, days: int = 7, lag: int = 1, least: int = 1) -> str:
    """PL with an aggregate over (t - days, t] of the lagged qty."""
    return f"""WITH {PL}, x AS (SELECT *, lag(qty, {lag}) OVER {W[5:]} AS x1 FROM pl)
      SELECT rf, ls, {DAY}, round(CASE WHEN count(x1) OVER r >= {least} THEN {expression} END, 4) AS {name}
      FROM x WINDOW r AS (PARTITION BY rf, ls ORDER BY dt RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW)"""


# Lags, differences, rolling statistics


@query("lag_features", f"WITH {PL} SELECT rf, ls, {DAY}, lag(qty, 1) OVER w AS qty_lag1, lag(qty, 7) OVER w AS qty_lag7 FROM pl WINDOW {W}")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.lag_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [1, 7], "qty"), PL_KEYS, "qty_lag1", "qty_lag7")


@query("difference_features", f"WITH {PL} SELECT rf, ls, {DAY}, qty - lag(qty, 1) OVER w AS qty_differenced_1, qty - lag(qty, 7) OVER w AS qty_differenced_7 FROM pl WINDOW {W}")
def difference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = lineitem_panel(spark, sf_dir)
    panel = ops.difference_features(ops.difference_features(panel, "dt", PL_KEYS, "qty", 1), "dt", PL_KEYS, "qty", 7)
    return shown(panel, PL_KEYS, "qty_differenced_1", "qty_differenced_7")


def _rolling(name: str, sql: str) -> None:
    column = f"qty_{name}_roll7_lag1"

    @query(f"rolling_{name}", rolling_sql(sql, column))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7], [name])
        return shown(out, PL_KEYS, column)


for _name, _sql in {
    "max": "max(x1) OVER r", "min": "min(x1) OVER r", "mean": "avg(x1) OVER r", "sum": "sum(x1) OVER r", "std": "stddev_samp(x1) OVER r", "var": "var_samp(x1) OVER r", "median": "quantile_cont(x1, 0.5) OVER r",
    "count": "CAST(count(x1) OVER r AS DOUBLE)", "skew": "CASE WHEN isnan(skewness(x1) OVER r) THEN NULL ELSE skewness(x1) OVER r END", "kurt": "CASE WHEN isnan(kurtosis(x1) OVER r) THEN NULL ELSE kurtosis(x1) OVER r END",
}.items():
    _rolling(_name, _sql)


@query("rolling_min_periods", rolling_sql("avg(x1) OVER r", "qty_mean_roll7_lag1", least=3))
def rolling_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7], ["mean"], min_periods=3), PL_KEYS, "qty_mean_roll7_lag1")


@query("rolling_default_periods", rolling_sql("avg(x1) OVER r", "qty_mean_roll7_lag1", least=5))
def rolling_default_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7], ["mean"], min_periods=None), PL_KEYS, "qty_mean_roll7_lag1")


@query("rolling_no_lag", rolling_sql("sum(x1) OVER r", "qty_sum_roll28", days=28, lag=0))
def rolling_no_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [28], ["sum"], lag=0), PL_KEYS, "qty_sum_roll28")


@query(
    "rolling_several",
    f"""WITH {PL}, x AS (SELECT *, lag(qty, 2) OVER {W[5:]} AS x1 FROM pl)
      SELECT rf, ls, {DAY}, round(avg(x1) OVER a, 4) AS qty_mean_roll7_lag2, round(max(x1) OVER a, 4) AS qty_max_roll7_lag2, round(avg(x1) OVER b, 4) AS qty_mean_roll28_lag2, round(max(x1) OVER b, 4) AS qty_max_roll28_lag2
      FROM x WINDOW a AS (PARTITION BY rf, ls ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), b AS (PARTITION BY rf, ls ORDER BY dt RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW)""",
)
def rolling_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7, 28], ["mean", "max"], lag=2)
    return shown(out, PL_KEYS, *(f"qty_{a}_roll{w}_lag2" for w in (7, 28) for a in ("mean", "max")))


@query(
    "rolling_subday",
    """WITH x AS (SELECT user_id, ts, event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS x1 FROM (SELECT user_id, ts, min(event_id) AS event_id, sum(value) AS value FROM events GROUP BY ALL))
      SELECT user_id, event_id, round(avg(x1) OVER r, 4) AS value_mean_roll7_lag1
      FROM x WINDOW r AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW)""",
)
def rolling_subday(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"), F.sum("value").alias("value"))
    out = ops.calc_statistical_features(raw, "ts", ["user_id"], "value", [7], ["mean"])
    return out.select("user_id", "event_id", rounded("value_mean_roll7_lag1").alias("value_mean_roll7_lag1"))


@query("momentum", rolling_sql("x1 / nullif(avg(x1) OVER r, 0)", "qty_mean_roll7_lag1_momentum"))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7], ["mean"], momentums=True), PL_KEYS, "qty_mean_roll7_lag1_momentum")


@query("share", rolling_sql("x1 / nullif(sum(x1) OVER r, 0)", "qty_sum_roll7_lag1_perc"))
def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_statistical_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7], ["sum"], percentages=True), PL_KEYS, "qty_sum_roll7_lag1_perc")


SEGMENTS = {"name": "across_priorities", "columns": ["seg"], "operation": "sum"}
SEG = f"{PO}, g AS (SELECT seg, dt, coalesce(sum(n), 0) AS n FROM po GROUP BY ALL), x AS (SELECT *, lag(n, 1) OVER (PARTITION BY seg ORDER BY dt) AS x1 FROM g)"
SEG_R = "WINDOW r AS (PARTITION BY seg ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"


@query("rolling_grouper", f"WITH {SEG}, y AS (SELECT seg, dt, sum(x1) OVER r AS v FROM x {SEG_R}) SELECT seg, prio, {DAY}, CAST(v AS DOUBLE) AS n_sum_across_priorities_roll7_lag1 FROM po LEFT JOIN y USING (seg, dt)")
def rolling_grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_statistical_features(orders_panel(spark, sf_dir), "dt", PO_KEYS, "n", [7], ["sum"], groupers=SEGMENTS), PO_KEYS, "n_sum_across_priorities_roll7_lag1")


@query("roll_up", f"WITH {PO} SELECT seg, {DAY}, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n FROM po GROUP BY seg, dt")
def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.rolled_up(orders_panel(spark, sf_dir), "dt", ["n"], ["seg"], "sum"), ["seg"], "n")


def ewma_sql(spans: tuple[int, ...], select: str, least: int = 1) -> str:
    parts = []
    for s in spans:
        keep = f"(1 - 2.0::DOUBLE / {s + 1})"
        parts.append(f"""e{s} AS (SELECT a.rf, a.ls, a.dt, CASE WHEN any_value(a.seen) >= {least} THEN sum(b.x1 * power({keep}, a.rn - b.rn)) / sum(power({keep}, a.rn - b.rn)) END AS v{s}
          FROM x a LEFT JOIN x b ON a.rf = b.rf AND a.ls = b.ls AND b.rn <= a.rn AND b.rn > a.rn - 330 AND b.x1 IS NOT NULL GROUP BY ALL)""")
    joins = " ".join(f"JOIN e{s} USING (rf, ls, dt)" for s in spans[1:])
    return f"""WITH {PL}, l AS (SELECT *, lag(qty, 1) OVER w AS x1, row_number() OVER w AS rn FROM pl WINDOW {W}),
      x AS (SELECT *, count(x1) OVER (PARTITION BY rf, ls ORDER BY rn) AS seen FROM l), {", ".join(parts)}
      SELECT rf, ls, {DAY}, {select} FROM e{spans[0]} {joins}"""


@query("ewma", ewma_sql((7,), "round(v7, 4) AS qty_ewma_roll7_lag1", 5))
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_ewma(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [7]), PL_KEYS, "qty_ewma_roll7_lag1")


@query("ewma_crossover", ewma_sql((7, 14), "round(v7, 4) AS qty_ewma_roll7_lag1, round(v14, 4) AS qty_ewma_roll14_lag1, round(v7 / nullif(v14, 0), 4) AS qty_ewma_roll7_lag1_cross14"))
def ewma_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.calc_ewma(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [14, 7], min_periods=1, crossovers=True)
    return shown(out, PL_KEYS, "qty_ewma_roll7_lag1", "qty_ewma_roll14_lag1", "qty_ewma_roll7_lag1_cross14")


@query("ewma_long_span", ewma_sql((56,), "round(v56, 4) AS qty_ewma_roll56_lag1").replace("a.rn - 330", "a.rn - 1400"))
def ewma_long_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_ewma(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", [56], min_periods=1), PL_KEYS, "qty_ewma_roll56_lag1")


def _threshold(operator: str, sign: str) -> None:
    column = f"n_perc_{operator}2_roll7_lag1"

    @query(
        f"threshold_share_{operator}",
        f"""WITH {PO}, x AS (SELECT *, lag(CAST(coalesce(n, 2) {sign} 2 AS INTEGER), 1) OVER (PARTITION BY seg, prio ORDER BY dt) AS x1 FROM po)
          SELECT seg, prio, {DAY}, round(avg(x1) OVER (PARTITION BY seg, prio ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS {column} FROM x""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(ops.calc_percent_relative_to_threshold(orders_panel(spark, sf_dir), "dt", PO_KEYS, "n", [7], threshold=2, operator=operator), PO_KEYS, column)


for _name, _sign in {"greater": ">", "less": "<", "equal": "=", "not_equal": "<>"}.items():
    _threshold(_name, _sign)


@query("pct_change", f"WITH {PL} SELECT rf, ls, {DAY}, round(lag(qty, 1) OVER w / nullif(lag(qty, 2) OVER w, 0) - 1, 4) AS qty_pct_change_lag1 FROM pl WINDOW {W}")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ops.calc_percent_change(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty"), PL_KEYS, "qty_pct_change_lag1")


@query("pct_change_grouper", f"WITH {PL} SELECT rf, ls, {DAY}, round(lag(qty, 1) OVER w / nullif(lag(qty, 2) OVER w, 0) - 1, 4) AS qty_by_flag_pct_change_lag1 FROM pl WINDOW w AS (PARTITION BY rf ORDER BY dt, ls)")
def pct_change_grouper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.calc_percent_change(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", groupers={"name": "by_flag", "columns": ["rf"]})
    return shown(out, PL_KEYS, "qty_by_flag_pct_change_lag1")


@query("days_since_release", f"WITH {PO} SELECT seg, prio, {DAY}, CAST(date_diff('day', min(dt) FILTER (n > 1) OVER (PARTITION BY seg, prio), dt) AS INTEGER) AS days_since_release FROM po QUALIFY days_since_release IS NOT NULL")
def days_since_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = orders_panel(spark, sf_dir).withColumn("more", F.col("n") - 1)
    return shown(ops.calc_days_since_release(panel, "dt", PO_KEYS, "more"), PO_KEYS, "days_since_release")


@query(
    "calendar_features",
    f"""WITH {PO} SELECT seg, prio, {DAY}, CAST(day(dt) AS INTEGER) AS day_of_month, CAST(isodow(dt) - 1 AS INTEGER) AS day_of_week, isodow(dt) >= 6 AS weekend_flag, CAST(strftime(dt, '%U') AS INTEGER) + 1 AS week,
      CAST(month(dt) AS INTEGER) AS month, CAST(year(dt) % 100 AS INTEGER) AS year, CAST(quarter(dt) AS INTEGER) AS quarter, strftime(dt, '%yM%m') AS month_year, strftime(dt, '%y') || 'Q' || quarter(dt) AS quarter_year FROM po""",
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["day_of_week", "weekend_flag", "week", "month", "year", "quarter", "month_year", "quarter_year"]
    out = ops.calc_datetime_features(orders_panel(spark, sf_dir), "dt", ["day", *parts])
    return shown(out, PO_KEYS, F.col("day").alias("day_of_month"), *parts)


# Preparation

SPINE = f"{PO}, spine AS (SELECT seg, prio, unnest(generate_series((SELECT min(dt) FROM po), (SELECT max(dt) FROM po), INTERVAL 1 DAY)) AS dt FROM (SELECT DISTINCT seg, prio FROM po)), full_ AS (SELECT s.*, n, amt FROM spine s LEFT JOIN po USING (seg, prio, dt))"


@query("gap_fill", f"WITH {SPINE} SELECT seg, prio, {DAY}, n FROM full_")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(transforms.fill_time_gaps(orders_panel(spark, sf_dir), "dt", PO_KEYS), PO_KEYS, "n")


@query("gap_fill_value", f"WITH {SPINE} SELECT seg, prio, {DAY}, coalesce(n, 0) AS n FROM full_")
def gap_fill_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(transforms.fill_time_gaps(orders_panel(spark, sf_dir), "dt", PO_KEYS, fill_value=0), PO_KEYS, "n")


@query(
    "gap_fill_per_series",
    f"""WITH {PO}, spine AS (SELECT seg, prio, unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS dt FROM po GROUP BY seg, prio)
      SELECT seg, prio, {DAY}, n FROM spine LEFT JOIN po USING (seg, prio, dt)""",
)
def gap_fill_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(transforms.fill_time_gaps(orders_panel(spark, sf_dir), "dt", PO_KEYS, per_series=True), PO_KEYS, "n")


@query("ffill", f"WITH {SPINE} SELECT seg, prio, {DAY}, last_value(n IGNORE NULLS) OVER (PARTITION BY seg, prio ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM full_")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = transforms.fill_time_gaps(orders_panel(spark, sf_dir), "dt", PO_KEYS)
    return shown(transforms.fill_missings(filled, "dt", PO_KEYS, "ffill", ["n"]), PO_KEYS, "n")


@query("bfill", f"WITH {SPINE} SELECT seg, prio, {DAY}, first_value(n IGNORE NULLS) OVER (PARTITION BY seg, prio ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM full_")
def bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = transforms.fill_time_gaps(orders_panel(spark, sf_dir), "dt", PO_KEYS)
    return shown(transforms.fill_missings(filled, "dt", PO_KEYS, "bfill", ["n"]), PO_KEYS, "n")


def _scaler(name: str, kind: str, sql: str) -> None:
    @query(f"scale_{name}", f"WITH {PL} SELECT rf, ls, {DAY}, round({sql}, 4) AS qty FROM pl")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = lineitem_panel(spark, sf_dir)
        return shown(transforms.apply_scalers(panel, [(kind, transforms.fit_scaler(panel, kind, ["qty"]))]), PL_KEYS, "qty")


_scaler("log1p", "log1p", "ln(1 + qty)")
_scaler("zscore", "standardize", "(qty - (SELECT avg(qty) FROM pl)) / (SELECT stddev_samp(qty) FROM pl)")
_scaler("minmax", "normalize", "(qty - (SELECT min(qty) FROM pl)) / ((SELECT max(qty) FROM pl) - (SELECT min(qty) FROM pl))")


@query("descale_round_trip", f"WITH {PL} SELECT rf, ls, {DAY}, round(qty, 4) AS qty, round(CAST(n AS DOUBLE), 4) AS n FROM pl")
def descale_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel.create(lineitem_panel(spark, sf_dir), "dt", "qty", PL_KEYS, check=False).log_features("qty").standardize_features(["qty", "n"]).normalize_features("n")
    from .specs import fit_scalers

    scaled, fitted = fit_scalers(panel.frame, panel.scalers)
    return shown(transforms.undo_scalers(scaled, fitted), PL_KEYS, "qty", "n")


@query("encode", "SELECT c_custkey, CAST(coalesce(dense_rank() OVER (ORDER BY c_mktsegment) - 1, -1) AS INTEGER) AS c_mktsegment FROM customer")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.encode_categoricals(load(spark, sf_dir, "customer"), ["c_mktsegment"])[0].select("c_custkey", "c_mktsegment")


@query("decode", "SELECT c_custkey, c_mktsegment FROM customer")
def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codes = transforms.encode_categoricals(load(spark, sf_dir, "customer"), ["c_mktsegment"])
    return transforms.decode_categoricals(coded, codes).select("c_custkey", "c_mktsegment")


@query("correct_negatives", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def correct_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.correct_negatives(load(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


def _least_type(column: str) -> str:
    """SQL: the name of the smallest integer type that holds the column (of values from 0)."""
    return f"(SELECT CASE WHEN max({column}) < 128 THEN 'tinyint' WHEN max({column}) < 32768 THEN 'smallint' WHEN max({column}) < 2147483648 THEN 'int' ELSE 'bigint' END FROM customer)"


@query("compress", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey, {_least_type('c_custkey')} AS custkey_type, {_least_type('c_nationkey')} AS nationkey_type FROM customer")
def compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = transforms.compress(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    return small.select(F.col("c_custkey").cast("bigint"), F.col("c_nationkey").cast("int"), F.typeof("c_custkey").alias("custkey_type"), F.typeof("c_nationkey").alias("nationkey_type"))


@query("join_demographics", "SELECT c_custkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.join_demographics(load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    return out.select("c_custkey", "n_name", F.col("n_regionkey").cast("int"))


@query("format_dates", f"WITH {PE} SELECT kind, strftime(dt, '%b. %-d %Y') AS label, n FROM pe")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.format_dates(events_panel(spark, sf_dir), "dt", "label").select("kind", "label", "n")


# Errors and summaries, with the value of seven rows ago as the forecast

NAIVE = f"{PL}, f AS (SELECT *, lag(qty, 7) OVER w AS predicted_qty FROM pl WINDOW {W})"


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lag_features(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty", 7, "qty").withColumnRenamed("qty_lag7", "predicted_qty")


ERRORS = 'qty AS "Actuals", predicted_qty AS "Predictions", abs((qty - predicted_qty) / nullif(qty, 0)) AS "Absolute Percent Error", abs(qty - predicted_qty) AS "Absolute Error", (qty - predicted_qty) * (qty - predicted_qty) AS "Squared Error"'


@query("row_errors", f'WITH {NAIVE} SELECT rf, ls, {DAY}, "Actuals", "Predictions", round("Absolute Percent Error", 4) AS "Absolute Percent Error", "Absolute Error", "Squared Error" FROM (SELECT *, {ERRORS} FROM f)')
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(summaries.row_errors(naive(spark, sf_dir), "qty", "predicted_qty"), PL_KEYS, *metrics.ROW_METRICS)


def _describe_part(name: str) -> str:
    c = f'"{name}"'
    return f"SELECT '{name}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM e"


@query("describe", f"WITH {NAIVE}, e AS (SELECT {ERRORS} FROM f) " + " UNION ALL ".join(map(_describe_part, metrics.ROW_METRICS)))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.described(summaries.row_errors(naive(spark, sf_dir), "qty", "predicted_qty"))
    return out.select("column", "count", *(rounded(c).alias(c) for c in out.columns[2:]))


def _metric(name: str, sql: str) -> None:
    @query(f"metric_{name}", f"WITH {NAIVE} SELECT round({sql}, 4) AS {name} FROM f")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.score(naive(spark, sf_dir), "qty", "predicted_qty", name).select(rounded(name).alias(name))


for _name, _sql in {
    "mape": "avg(abs((qty - predicted_qty) / nullif(qty, 0)))", "mapa": "1 - avg(abs((qty - predicted_qty) / nullif(qty, 0)))", "mae": "avg(abs(qty - predicted_qty))",
    "mse": "avg((qty - predicted_qty) * (qty - predicted_qty))", "rmse": "sqrt(avg((qty - predicted_qty) * (qty - predicted_qty)))",
}.items():
    _metric(_name, _sql)


@query("metric_pinball", f"WITH {NAIVE} SELECT round(avg(CASE WHEN qty >= predicted_qty THEN 0.9 * (qty - predicted_qty) WHEN qty < predicted_qty THEN 0.1 * (predicted_qty - qty) END), 4) AS pinball FROM f")
def metric_pinball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir).agg(rounded(F.avg(metrics.pinball(F.col("qty"), F.col("predicted_qty"), 0.9))).alias("pinball"))


@query("weighted_ape", f'WITH {NAIVE}, e AS (SELECT rf, {ERRORS} FROM f) SELECT rf, round(sum("Absolute Percent Error" * "Actuals") / nullif(sum("Actuals") FILTER ("Absolute Percent Error" IS NOT NULL), 0), 4) AS value FROM e GROUP BY rf')
def weighted_ape(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = summaries.row_errors(naive(spark, sf_dir), "qty", "predicted_qty")
    return errors.groupBy("rf").agg(rounded(metrics.weighted_mean(F.col("Absolute Percent Error"), F.col("Actuals"))).alias("value"))


@query("missing_fraction", f"WITH {NAIVE}, m AS (SELECT rf, ls, dt, qty, n, predicted_qty FROM f) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INTEGER)), 4) AS missing FROM m" for c in ("rf", "ls", "dt", "qty", "n", "predicted_qty")))
def missing_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.missing_fractions(naive(spark, sf_dir)).select("column", rounded("missing").alias("missing"))


@query("confidence_band", f"WITH {NAIVE} SELECT rf, ls, {DAY}, round(predicted_qty + b, 4) AS predicted_qty_upper, round(predicted_qty - b, 4) AS predicted_qty_lower FROM f, (SELECT 1.9599639845400536 * stddev_samp(predicted_qty) / sqrt(count(predicted_qty)) AS b FROM f)")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relational.add_confidence_band(naive(spark, sf_dir), "predicted_qty"), PL_KEYS, "predicted_qty_upper", "predicted_qty_lower")


@query("forecast_minimum", f"WITH {NAIVE} SELECT rf, ls, {DAY}, CASE WHEN predicted_qty > 100 THEN predicted_qty ELSE 100 END AS predicted_qty FROM f")
def forecast_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(transforms.set_forecast_minimum(naive(spark, sf_dir), 100), PL_KEYS, "predicted_qty")


@query("rows_with_missing", f"WITH {NAIVE} SELECT rf, ls, {DAY}, qty FROM f WHERE predicted_qty IS NULL")
def rows_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relational.filter_on_infs_nans(naive(spark, sf_dir)), PL_KEYS, "qty")


# Folds, future, joins

FOLDS = f"""{PL}, d AS (SELECT *, dense_rank() OVER (ORDER BY dt) - 1 AS p FROM pl), k AS (SELECT max(p) + 1 AS m FROM d),
  b AS (SELECT CAST(k AS INTEGER) AS fold, m - (3 - k) * (m // 4) - 2 AS train_end, m - (3 - k) * (m // 4) AS test_start, m - (2 - k) * (m // 4) AS test_end FROM k, (SELECT unnest(range(3)) AS k))"""


@query("fold_assignment", f"WITH {FOLDS} SELECT rf, ls, {DAY}, fold, CASE WHEN p < train_end THEN 'train' ELSE 'test' END AS sample FROM d, b WHERE p < train_end OR (p >= test_start AND p < test_end)")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(split.fold_assignment(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, folds=3, gap=2), PL_KEYS, "fold", "sample")


@query("fold_assignment_rows", f"WITH {PL}, d AS (SELECT *, row_number() OVER (ORDER BY dt, rf, ls) - 1 AS p, count(*) OVER () AS m FROM pl) SELECT rf, ls, {DAY}, k AS fold, CASE WHEN p < m - (2 - k) * (m // 3) THEN 'train' ELSE 'test' END AS sample FROM d, (SELECT CAST(unnest(range(2)) AS INTEGER) AS k) WHERE p < m - (1 - k) * (m // 3)")
def fold_assignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(split.fold_assignment(lineitem_panel(spark, sf_dir), "dt", PL_KEYS, folds=2, unit="row"), PL_KEYS, "fold", "sample")


@query(
    "masked_fold_features",
    f"""WITH {FOLDS}, u AS (SELECT d.*, p < train_end AS is_train, CASE WHEN p < train_end THEN qty END AS seen FROM d, b WHERE fold = 2 AND (p < train_end OR (p >= test_start AND p < test_end))),
      x AS (SELECT *, lag(seen, 1) OVER {W[5:]} AS x1, lag(seen, 2) OVER {W[5:]} AS x2 FROM u)
      SELECT rf, ls, {DAY}, qty, x2 AS qty_lag2, round(avg(x1) OVER (PARTITION BY rf, ls ORDER BY dt RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS qty_mean_roll7_lag1, CASE WHEN is_train THEN 'train' ELSE 'test' END AS sample FROM x""",
)
def masked_fold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel.create(lineitem_panel(spark, sf_dir), "dt", "qty", PL_KEYS, check=False).lag_features("qty", 2).calc_statistical_features("qty", windows=[7], aggregations=["mean"])
    n = panel.frame.select("dt").distinct().count()
    train, test, _ = panel.fold_data(split.fold_bounds(n, 3, 2)[2])
    both = relational.union_tagged({"train": train, "test": test}, "sample")
    return shown(both, PL_KEYS, "qty", "qty_lag2", "qty_mean_roll7_lag1", "sample")


@query("future_frame", f"WITH {PO} SELECT seg, prio, strftime(dt, '%Y-%m-%d') AS day, CAST(NULL AS BIGINT) AS n FROM (SELECT DISTINCT seg, prio FROM po), (SELECT unnest(generate_series(max(dt) + INTERVAL 1 DAY, max(dt) + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS dt FROM po)")
def future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(split.future_frame(orders_panel(spark, sf_dir), "dt", PO_KEYS, "n", 14, include_history=False), PO_KEYS, "n")


@query(
    "future_features",
    f"""WITH {PO}, f AS (SELECT seg, prio, dt, n, false AS new FROM po UNION ALL SELECT seg, prio, unnest(generate_series(m + INTERVAL 1 DAY, m + INTERVAL 7 DAY, INTERVAL 1 DAY)), NULL, true FROM (SELECT DISTINCT seg, prio FROM po), (SELECT max(dt) AS m FROM po))
      SELECT seg, prio, {DAY}, n_lag7 FROM (SELECT *, CAST(lag(n, 7) OVER (PARTITION BY seg, prio ORDER BY dt) AS DOUBLE) AS n_lag7 FROM f) WHERE new""",
)
def future_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel.create(orders_panel(spark, sf_dir), "dt", "n", PO_KEYS, check=False).lag_features("n", 7)
    return shown(panel.make_future(7, include_history=False), PO_KEYS, "n_lag7")


@query("merge_actuals", f"WITH {NAIVE} SELECT rf, ls, {DAY}, qty, predicted_qty FROM (SELECT rf, ls, dt, predicted_qty FROM f WHERE predicted_qty IS NOT NULL) FULL JOIN pl USING (rf, ls, dt)")
def merge_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = naive(spark, sf_dir).where("predicted_qty is not null").drop("qty", "n")
    return shown(relational.merge_actuals(predicted, lineitem_panel(spark, sf_dir), "dt", PL_KEYS, "qty"), PL_KEYS, "qty", "predicted_qty")


@query("update_join", f"WITH {NAIVE} SELECT rf, ls, {DAY}, coalesce(CASE WHEN rf = 'A' THEN predicted_qty END, qty) AS qty FROM f")
def update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = naive(spark, sf_dir).where("rf = 'A'").select("rf", "ls", "dt", F.col("predicted_qty").alias("qty"))
    return shown(relational.update_values(lineitem_panel(spark, sf_dir), second, [*PL_KEYS, "dt"]), PL_KEYS, "qty")


@query("semi_filter", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.filter_on_keys(load(spark, sf_dir, "customer"), ["c_custkey"], wanted).select("c_custkey")


@query("left_merge", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return relational.merge_left(load(spark, sf_dir, "nation"), region, ["n_regionkey"]).select("n_name", "r_name")


@query("dedupe", f"WITH {PO} SELECT DISTINCT seg, prio FROM po")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_panel(spark, sf_dir).select(*PO_KEYS).distinct()


@query("union_tag", f"WITH {PE} SELECT kind, {DAY}, n, CASE WHEN dt < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS _sample_name FROM pe")
def union_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = relational.split_on_date(events_panel(spark, sf_dir), "dt", "2024-01-20")
    return shown(relational.union_tagged({"train": before, "test": after}), PE_KEYS, "n", "_sample_name")


@query("unpivot", f"WITH {PE} SELECT kind, {DAY}, variable, round(value, 4) AS value FROM (SELECT kind, dt, CAST(n AS DOUBLE) AS n, v FROM pe) UNPIVOT INCLUDE NULLS (value FOR variable IN (n, v))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relational.long_form(events_panel(spark, sf_dir), ["kind", "dt"], ["n", "v"]), PE_KEYS, "variable", "value")


@query("date_differences", f"WITH {PE} SELECT DISTINCT CAST(date_diff('day', (SELECT max(dt) FROM pe), dt) AS INTEGER) AS days FROM pe")
def date_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.date_differences(events_panel(spark, sf_dir), "dt")


@query("feature_topk", "SELECT c_name AS feature, abs(c_acctbal) AS importance FROM customer ORDER BY importance DESC, feature LIMIT 10")
def feature_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_features(load(spark, sf_dir, "customer").select(F.col("c_name").alias("feature"), F.abs("c_acctbal").alias("importance")), 10)


@query("hierarchy_column", f"WITH {PO} SELECT {DAY}, n, concat_ws('-', seg, prio) AS hierarchy FROM po")
def hierarchy_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relational.hierarchy_column(orders_panel(spark, sf_dir), PO_KEYS), [], "n", "hierarchy")


@query("preview", f"WITH {PE} SELECT kind, {DAY}, n FROM pe ORDER BY dt, kind LIMIT 20")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relational.preview(events_panel(spark, sf_dir), "dt", PE_KEYS, 20), PE_KEYS, "n")


NAIVE_FOLDS = f"""{FOLDS.replace(PL, NAIVE)}, e AS (
  SELECT f.*, fold, CASE WHEN p < train_end THEN 'train' ELSE 'test' END AS sample, {ERRORS} FROM f JOIN (SELECT rf, ls, dt, p FROM d) USING (rf, ls, dt), b WHERE p < train_end OR (p >= test_start AND p < test_end))"""


def naive_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.fold_assignment(naive(spark, sf_dir), "dt", PL_KEYS, folds=3, gap=2)


@query("fold_errors", f'WITH {NAIVE_FOLDS} SELECT fold, sample, count(*) AS n, ' + ", ".join(f'round(avg("{c}"), 4) AS "{c}"' for c in metrics.ROW_METRICS) + " FROM e GROUP BY fold, sample")
def fold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.fold_errors(naive_folds(spark, sf_dir), "qty", "predicted_qty")
    return out.select("fold", "sample", "n", *(rounded(c).alias(c) for c in metrics.ROW_METRICS))


@query("summary_median", f'WITH {NAIVE_FOLDS} SELECT sample, round(quantile_cont("Absolute Percent Error", 0.5), 4) AS value FROM e WHERE fold = 2 GROUP BY sample')
def summary_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = summaries.row_errors(naive_folds(spark, sf_dir), "qty", "predicted_qty")
    return summaries.summarised(errors, "median", 2).select("sample", rounded("value").alias("value"))


@query("summary_weighted", f'WITH {NAIVE_FOLDS} SELECT sample, round(sum("Absolute Percent Error" * "Actuals") / nullif(sum("Actuals") FILTER ("Absolute Percent Error" IS NOT NULL), 0), 4) AS value FROM e GROUP BY sample')
def summary_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = summaries.row_errors(naive_folds(spark, sf_dir), "qty", "predicted_qty")
    return summaries.summarised(errors, "weighted").select("sample", rounded("value").alias("value"))


@query("errors_by_fold_frame", f'WITH {NAIVE_FOLDS} SELECT fold, sample, metric, round(value, 4) AS value FROM (SELECT fold, sample, ' + ", ".join(f'"{c}"' for c in metrics.ROW_METRICS) + ' FROM e) UNPIVOT INCLUDE NULLS (value FOR metric IN (' + ", ".join(f'"{c}"' for c in metrics.ROW_METRICS) + "))")
def errors_by_fold_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.errors_by_fold_frame(naive_folds(spark, sf_dir), "qty", "predicted_qty")
    return out.select("fold", "sample", "metric", rounded("value").alias("value"))


@query("predictions_frame", f'WITH {NAIVE} SELECT rf, ls, {DAY}, series, round(value, 4) AS value FROM (SELECT rf, ls, dt, qty AS "Actual", predicted_qty AS "Prediction" FROM f) UNPIVOT INCLUDE NULLS (value FOR series IN ("Actual", "Prediction"))')
def predictions_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(summaries.predictions_frame(naive(spark, sf_dir), "dt", PL_KEYS, "qty", "predicted_qty"), PL_KEYS, "series", "value")


@query("asymmetric_error", f"WITH {NAIVE} SELECT rf, round(avg((qty - predicted_qty) * (qty - predicted_qty) * CASE WHEN qty > predicted_qty THEN 10 ELSE 1 END), 4) AS error FROM f GROUP BY rf")
def asymmetric_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = metrics.asymmetric_squared_error(F.col("qty"), F.col("predicted_qty"))
    return naive(spark, sf_dir).groupBy("rf").agg(rounded(F.avg(error)).alias("error"))


@query("weighted_rmse", f"WITH {NAIVE} SELECT rf, round(sqrt(sum((qty - predicted_qty) * (qty - predicted_qty) * n) / sum(n) FILTER (predicted_qty IS NOT NULL)), 4) AS rmse FROM f GROUP BY rf")
def weighted_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = metrics.rmse(F.col("qty"), F.col("predicted_qty"), F.col("n").cast("double"))
    return naive(spark, sf_dir).groupBy("rf").agg(rounded(error).alias("rmse"))


@query("short_lags_dropped", f"WITH {PL} SELECT rf, ls, {DAY}, lag(qty, 7) OVER w AS qty_lag7 FROM pl WINDOW {W}")
def short_lags_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = Panel.create(lineitem_panel(spark, sf_dir), "dt", "qty", PL_KEYS, check=False).lag_features("qty", [1, 7]).calc_statistical_features("qty", windows=[7], aggregations=["mean"], momentums=True)
    out = panel.data(min_lag_dict={"qty": 7})
    return shown(out, PL_KEYS, *(c for c in out.columns if c.startswith("qty_")))


@query("load_test_copies", "SELECT r_name, count(*) AS n FROM region, (SELECT unnest(range(8))) GROUP BY r_name")
def load_test_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.repeated(load(spark, sf_dir, "region"), 3).groupBy("r_name").agg(F.count("*").alias("n"))


@query("first_rows", f"WITH {PO} SELECT seg, prio, {DAY}, n FROM po QUALIFY row_number() OVER (PARTITION BY seg, prio ORDER BY dt) <= 3")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(relational.first_rows_of_groups(orders_panel(spark, sf_dir), "dt", PO_KEYS, 3), PO_KEYS, "n")


# Models: not expressible in SQL


def forecast_panel(spark: SparkSession, sf_dir: str) -> Panel:
    panel = Panel.create(events_panel(spark, sf_dir), "dt", "v", PE_KEYS, check=False).standardize_features("v")
    return panel.lag_features("v", [1, 2]).calc_statistical_features("v", windows=[7], aggregations=["mean", "max"]).calc_datetime_features(["day_of_week", "week"])


@query("gbt_forecast")
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_panel(spark, sf_dir).predict("gbt", future_periods=3, maxIter=5, maxDepth=3).get_predictions()


@query("trend_seasonal_forecast")
def trend_seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_panel(spark, sf_dir).predict("trend_seasonal", future_periods=3).get_predictions()


@query("seasonal_normal_equations", "SELECT unnest(['__one', '__trend', '__sin_w1', '__cos_w1', '__sin_w2', '__cos_w2']) AS regressor, CAST(0 AS DOUBLE) AS mean_product, CAST(0 AS DOUBLE) AS outside")
def seasonal_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What defines least squares: errors are orthogonal to every regressor.  Components sum to the forecast."""
    from ..operators import models

    frame = events_panel(spark, sf_dir).where("v is not null")
    out = models.fit(frame, "dt", PE_KEYS, "v", "trend_seasonal").predict(frame, "p")
    out, _ = models.waves(out.withColumn("__one", F.lit(1.0)), "dt")
    error = F.col("v").cast("double") - F.col("p")
    named = ["__one", "__trend", "__sin_w1", "__cos_w1", "__sin_w2", "__cos_w2"]
    sums = out.agg(*(F.abs(F.round(F.avg(error * F.col(c)), 3)).alias(c) for c in named), F.abs(F.round(F.max(F.abs(F.col("trend") + F.col("yearly") + F.col("weekly") - F.col("p"))), 4)).alias("outside"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("regressor"), F.col(c).alias("mean_product")) for c in named))).alias("x"), "outside").select("x.*", "outside")


@query("quantile_blend", "SELECT c_custkey, round((0.3 * c_acctbal + 1.0 * c_custkey + 0.3 * coalesce(c_nationkey, 0)) / (1.3 + CASE WHEN c_nationkey IS NULL THEN 0 ELSE 0.3 END), 4) AS blend FROM customer")
def quantile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import models

    out = models.blended(load(spark, sf_dir, "customer"), {0.1: "c_acctbal", 0.5: "c_custkey", 0.9: "c_nationkey"}, "blend")
    return out.select("c_custkey", rounded("blend").alias("blend"))


@query("row_folds", f"""WITH {PO}, r AS (SELECT *, row_number() OVER (ORDER BY dt, seg, prio) - 1 AS pos, count(*) OVER () AS rows FROM po),
  b AS (SELECT unnest(range(0, 3)) AS fold), m AS (SELECT r.*, fold, CAST(floor(rows / 4) AS BIGINT) AS size FROM r, b),
  s AS (SELECT *, CASE WHEN pos < rows - (3 - fold) * size THEN 'train' WHEN pos < rows - (2 - fold) * size THEN 'test' END AS sample FROM m)
  SELECT CAST(fold AS INTEGER) AS fold, sample, count(*) AS n_rows, sum(pos) AS positions FROM s WHERE sample IS NOT NULL GROUP BY ALL""")
def row_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _ = split.positioned(orders_panel(spark, sf_dir), "dt", PO_KEYS, "row")
    marked = split.fold_assignment(ranked, "dt", PO_KEYS, 3, 0, "row")
    return marked.groupBy("fold", "sample").agg(F.count("*").alias("n_rows"), F.sum(F.col("__position").cast("long")).alias("positions"))


@query("cv_errors")
def cv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = forecast_panel(spark, sf_dir).cross_validate("gbt", folds=2, params={"maxIter": [3], "maxDepth": [2, 3]}, n_iter=2, parallelism=1)
    return done.get_cross_validation_errors()


@query("importances")
def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_features(forecast_panel(spark, sf_dir).predict("gbt", maxIter=3, maxDepth=3).importances(), 10)
