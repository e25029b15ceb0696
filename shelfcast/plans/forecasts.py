"""Registered queries: backtests, scores, comparisons and diagnostics."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest, checks, cohort, diagnostics, scoring
from ..session import written
from ..sources import tables
from .registry import query

P = tables.PROTOCOL
BASELINES, SMOOTHING = list(P.baselines), list(P.smoothing)
NEXT_START = dict(zip(P.forecast_starts, P.forecast_starts[1:] + P.forecast_starts[:1]))
PAIRS = scoring.pair_list(BASELINES, BASELINES)
CANDIDATE, COMPARATOR = "weekday_mean_4w", "seasonal_naive"
# Display names of the methods.
LABELS = {
    "hw_expanding": "Expanding-history smoothing",
    "hw_182d": "182-day smoothing",
    "hw_365d": "365-day smoothing",
    "seasonal_naive": "Last-week repetition",
    "weekday_mean_4w": "Four-week weekday average",
    "weekday_mean_8w": "Eight-week weekday average",
}
SCORES = ("mae:f wape:f signed_bias:f percentage_bias:f overprediction_units:f "
          "underprediction_units:f absolute_error_sum:f actual_units:f observations:i")
DETAIL = ("model:s baseline:s product_id:s outcome:s model_wape:f baseline_wape:f "
          "error_reduction_units:f relative_wape_reduction_pct:f")
PAIRWISE = ("model:s baseline:s model_wape:f baseline_wape:f relative_wape_reduction_pct:f "
            "error_reduction_units:f wins:i losses:i ties:i undefined:i comparable_products:i win_pct:f")
LONG = ("model:s product_id:s forecast_start:d forecast_end:d date:d origin:d horizon_day:i "
        "actual:f prediction:f status:s")
DAY = "product_id:s forecast_start:d date:d"


def shop_of(spark, sf_dir, columns=tables.UNITS) -> tables.Shop:
    return tables.Shop.read(spark, sf_dir, columns)


def grid_of(spark, sf_dir) -> DataFrame:
    return shop_of(spark, sf_dir).saved_grid()


def labelled(spark, sf_dir) -> DataFrame:
    return shop_of(spark, sf_dir).backtest()


def predictions(spark, sf_dir) -> DataFrame:
    return staged_as(labelled(spark, sf_dir), F.lit("robustness"))


def staged_as(rows: DataFrame, stage) -> DataFrame:
    return rows.withColumns({"stage": stage, "split": F.date_format("forecast_start", "yyyy-MM-dd")})


def smoothing_protocol(shop: tables.Shop, methods: dict[str, int | None]):
    return replace(shop.protocol(), smoothing=methods)


def all_methods(spark, sf_dir) -> DataFrame:
    return shop_of(spark, sf_dir).full_backtest()


def products(spark, sf_dir, *period) -> DataFrame:
    return scoring.product_summaries(predictions(spark, sf_dir), *period)


def detail(spark, sf_dir, pairs=PAIRS) -> DataFrame:
    return scoring.product_comparisons(products(spark, sf_dir), pairs, P.tie_tolerance)


def detail_and_names(spark, sf_dir, pairs=PAIRS) -> tuple[DataFrame, DataFrame]:
    return detail(spark, sf_dir, pairs), shop_of(spark, sf_dir, tables.NAMED).names()


def staged(spark, sf_dir) -> DataFrame:
    """The first three origins serve as validation, the others as test."""
    validation = F.col("forecast_start") < F.lit(date(1998, 7, 1))
    return staged_as(labelled(spark, sf_dir), F.when(validation, "validation").otherwise("test"))


_STAGED = ("(SELECT *, CASE WHEN forecast_start < DATE '1998-07-01' THEN 'validation' ELSE 'test' END "
           "AS stage FROM errors) AS staged")


# --- forecasts ----------------------------------------------------------------------


@query("e1_rolling_origin_splits",
       "split:s stage:s train_start:d train_end:d forecast_start:d forecast_end:d training_days:i "
       "horizon_days:i",
       """SELECT CAST(forecast_start AS VARCHAR) AS split, 'robustness' AS stage, first_day AS train_start,
  forecast_start - 1 AS train_end, forecast_start, forecast_start + 27 AS forecast_end,
  forecast_start - first_day AS training_days, 28 AS horizon_days FROM origins, bounds""")
def e1(spark, sf_dir):
    shop = shop_of(spark, sf_dir, ())
    return cohort.rolling_origin_splits(spark, shop.protocol(), shop.bounds)


@query("e2_training_windows",
       "product_id:s model:s forecast_start:d train_start:d train_end:d training_observations:i "
       "history_units:f",
       """SELECT g.product_id, m.model, o.forecast_start, MIN(g.date) AS train_start, MAX(g.date) AS train_end,
  COUNT(*) AS training_observations, SUM(g.units) AS history_units
FROM origins o CROSS JOIN (SELECT * FROM methods UNION ALL VALUES ('hw_expanding', NULL),
  ('hw_182d', 182), ('hw_365d', 365)) m
JOIN grid g ON g.date < o.forecast_start
  AND (m.history IS NULL OR g.date >= o.forecast_start - m.history)
GROUP BY 1, 2, 3""")
def e2(spark, sf_dir):
    """Each window's days and units, from running sums at its two ends."""
    shop = shop_of(spark, sf_dir)
    return backtest.history_sums(shop.saved_grid(), shop.protocol())


@query("e3_forecast_seasonal_naive", LONG,
       "SELECT *, 'ok' AS status FROM predictions WHERE model = 'seasonal_naive'")
def e3(spark, sf_dir):
    return predictions(spark, sf_dir).filter(F.col("model") == "seasonal_naive")


@query("e4_forecast_weekday_mean", LONG,
       "SELECT *, 'ok' AS status FROM predictions WHERE model <> 'seasonal_naive'")
def e4(spark, sf_dir):
    return predictions(spark, sf_dir).filter(F.col("model") != "seasonal_naive")


@query("e5_forecast_weekly_smoothing", LONG,
       """SELECT 'hw_weekly' AS model, product_id, forecast_start, forecast_end, date, origin, horizon_day, actual,
  prediction, 'ok' AS status FROM smooth_predictions WHERE model = 'hw_expanding'""")
def e5(spark, sf_dir):
    shop = shop_of(spark, sf_dir)
    protocol = smoothing_protocol(shop, {"hw_weekly": None})
    found = backtest.smoothing_fits(shop.saved_grid(), protocol)
    return backtest.backtest_long_frame(shop.saved_grid(), protocol, found).filter(F.col("model") == "hw_weekly")


@query("e6_forecast_window_variants",
       "product_id:s model:s forecast_start:d train_start:d train_end:d training_observations:i "
       "status:s level_gain:f seasonal_gain:f sse:f",
       """SELECT f.product_id, f.model, f.forecast_start, p.first_day AS train_start, f.forecast_start - 1 AS train_end,
  f.forecast_start - p.first_day AS training_observations, 'ok' AS status, f.a AS level_gain, f.g AS seasonal_gain,
  f.rounded_sse AS sse
FROM smooth_fits f JOIN smooth_spans p ON p.model = f.model AND COALESCE(p.own_start, f.forecast_start) = f.forecast_start""")
def e6(spark, sf_dir):
    shop = shop_of(spark, sf_dir)
    return backtest.smoothing_fits(shop.saved_grid(), shop.protocol())


@query("e7_fallback_policy", f"model:s {DAY} status:s error:s warnings:i clipped:i prediction:f",
       """SELECT s.model, p.product_id, p.forecast_start, p.date, 'failure_baseline_fallback' AS status,
  'the history is shorter than two weeks' AS error, 0 AS warnings, 0 AS clipped, p.prediction
FROM predictions p, (VALUES ('hw_10d')) AS s(model) WHERE p.model = 'seasonal_naive'
UNION ALL SELECT model, product_id, forecast_start, date, 'ok', NULL, CASE WHEN at_end THEN 1 ELSE 0 END,
  CASE WHEN unclipped < 0 THEN 1 ELSE 0 END, GREATEST(unclipped, 0) FROM smooth_forecasts WHERE model = 'hw_182d'""")
def e7(spark, sf_dir):
    """A history of ten days cannot be fitted, so the last-week repeat stands in; one of 182 days can.

    Warnings alone change nothing.
    """
    shop = shop_of(spark, sf_dir)
    protocol = smoothing_protocol(shop, {"hw_10d": 10, "hw_182d": 182})
    fits = backtest.smoothing_fits(shop.saved_grid(), protocol)
    rows = backtest.smoothing_forecasts(fits, backtest.baseline_support(shop.saved_grid(), protocol), protocol)
    notes = fits.select("product_id", "forecast_start", "model", "error", F.size("warnings").alias("warnings"))
    return rows.join(notes, ["product_id", "forecast_start", "model"]).withColumn(
        "clipped", (F.col("unclipped") < 0).cast("long"))


@query("e8_clip_nonnegative", f"{DAY} shifted:f prediction:f",
       "SELECT product_id, forecast_start, date, prediction - 20 AS shifted, "
       "GREATEST(prediction - 20, 0) AS prediction FROM predictions WHERE model = 'weekday_mean_4w'")
def e8(spark, sf_dir):
    """Forecasts lowered by 20 units, so that some fall below the floor."""
    support = backtest.baseline_support(grid_of(spark, sf_dir), P)
    return support.withColumn("shifted", F.col("weekday_mean_4w") - 20).withColumn(
        "prediction", backtest.clip_nonnegative(F.col("shifted"), P))


@query("e9_backtest_long_frame", f"stage:s split:s {LONG}",
       "SELECT 'robustness' AS stage, CAST(forecast_start AS VARCHAR) AS split, *, 'ok' AS status "
       "FROM predictions")
def e9(spark, sf_dir):
    return predictions(spark, sf_dir)


WINDOWED = f"experiment:s {LONG} train_start:d training_observations:i spike_threshold:f is_spike:b"


@query("e10_window_backtest_frame", WINDOWED,
       "SELECT 'training_windows_v1' AS experiment, *, 'ok' AS status FROM labelled")
def e10(spark, sf_dir):
    return labelled(spark, sf_dir)


@query("e10_window_backtest_all_methods", WINDOWED,
       "SELECT 'training_windows_v1' AS experiment, *, 'ok' AS status FROM labelled_all")
def e10_all(spark, sf_dir):
    return all_methods(spark, sf_dir)


def lowered(spark, sf_dir) -> DataFrame:
    """Forecasts lowered by 20 units, so that some days fall below the floor and are clipped."""
    below = F.col("unclipped") - 20
    return labelled(spark, sf_dir).withColumn("unclipped", below).withColumn(
        "prediction", backtest.clip_nonnegative(F.col("unclipped"), P))


@query("e11_fit_records",
       "model:s product_id:s forecast_start:d train_start:d train_end:d training_observations:i "
       "status:s negative_predictions_clipped:i",
       """SELECT model, product_id, forecast_start, MIN(train_start) AS train_start, MIN(origin) AS train_end,
  MIN(training_observations) AS training_observations, 'ok' AS status,
  COUNT(*) FILTER (WHERE prediction - 20 < 0) AS negative_predictions_clipped
FROM predictions GROUP BY 1, 2, 3""")
def e11(spark, sf_dir):
    return backtest.baseline_fit_records(lowered(spark, sf_dir))


@query("e11_smoothing_events",
       "model:s product_id:s forecast_start:d training_observations:i status:s warnings:s "
       "negative_predictions_clipped:i",
       """SELECT f.model, f.product_id, f.forecast_start, f.forecast_start - any_value(p.first_day) AS training_observations,
  'ok' AS status, CASE WHEN bool_or(at_end) THEN 'the level gain is the greatest that was tried' ELSE '' END AS warnings,
  COUNT(*) FILTER (WHERE unclipped < 0) AS negative_predictions_clipped
FROM smooth_forecasts f JOIN smooth_spans p ON p.model = f.model AND COALESCE(p.own_start, f.forecast_start) = f.forecast_start
GROUP BY 1, 2, 3 HAVING bool_or(at_end) OR bool_or(unclipped < 0)""")
def e11_events(spark, sf_dir):
    shop = shop_of(spark, sf_dir)
    events = backtest.fit_events(backtest.fit_records(shop.fits(), shop.protocol()))
    return events.withColumn("warnings", F.concat_ws("; ", "warnings"))


_BROKEN = """(SELECT *, horizon_day + CASE WHEN model = 'weekday_mean_4w' AND day(date) = 11 THEN 1 ELSE 0 END AS shifted,
    actual + CASE WHEN model = 'seasonal_naive' AND day(date) = 12 THEN 1 ELSE 0 END AS changed,
    CASE WHEN model = 'weekday_mean_8w' AND prediction > 25 THEN 'unlisted' ELSE model END AS named
  FROM labelled JOIN (SELECT unnest([1, 2]) AS copy) AS copies
    ON copy = 1 OR model = 'weekday_mean_4w' AND day(date) = 13
  WHERE day(date) <> 14) AS broken"""


@query("e12_support_validation", "check:s product_id:s forecast_start:d rows:i",
       f"""SELECT * FROM (
  SELECT "check", product_id, forecast_start, COUNT(*) AS "rows"
  FROM (SELECT product_id, forecast_start, date, unnest([
      CASE WHEN COUNT(*) > COUNT(DISTINCT named) THEN 'duplicate_key' END,
      CASE WHEN COUNT(DISTINCT named) <> 3 OR bool_or(named = 'unlisted') THEN 'method_coverage' END,
      CASE WHEN MIN(changed) <> MAX(changed) THEN 'support_differs' END]) AS "check"
    FROM {_BROKEN} GROUP BY 1, 2, 3) AS d WHERE "check" IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL SELECT 'not_consecutive', product_id, forecast_start, COUNT(*) FROM {_BROKEN}
    WHERE date - forecast_start + 1 <> shifted GROUP BY 2, 3
  UNION ALL SELECT 'horizon_coverage', product_id, forecast_start, 28 - COUNT(DISTINCT date) FROM {_BROKEN} GROUP BY 2, 3
) AS found WHERE "rows" > 0""")
def e12(spark, sf_dir):
    """Saved predictions broken in every way that the checks look for."""
    shop, day = shop_of(spark, sf_dir), F.dayofmonth("date")
    high = (F.col("model") == "weekday_mean_8w") & (F.col("prediction") > 25)
    four, naive = F.col("model") == "weekday_mean_4w", F.col("model") == "seasonal_naive"
    copies = F.when(four & (day == 13), 2).otherwise(1)
    rows = shop.backtest().filter(day != 14).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    rows = rows.withColumns({
        "horizon_day": F.col("horizon_day") + F.when(four & (day == 11), 1).otherwise(0),
        "actual": F.col("actual") + F.when(naive & (day == 12), 1).otherwise(0),
        "model": F.when(high, "unlisted").otherwise(F.col("model"))})
    return checks.support_validation(rows, shop.chosen(), BASELINES, P)


@query("e12_refused_backtests", "case:s refused:b",
       "SELECT * FROM (VALUES ('whole', FALSE), ('gap', TRUE), ('repeat', TRUE), ('negative', TRUE), ('lost product', TRUE)) "
       "AS c(\"case\", refused) WHERE EXISTS (SELECT 1 FROM cohort)")
def e12_refused(spark, sf_dir):
    """Grids that a backtest must not use, each broken on one day, beside the whole one."""
    shop, bad = shop_of(spark, sf_dir), F.col("date") == F.lit(date(1998, 2, 3))
    grid = shop.saved_grid()
    lost = shop.chosen().agg(F.min("product_id")).scalar()
    cases = {
        "whole": grid, "gap": grid.filter(~bad), "repeat": grid.unionByName(grid.filter(bad)),
        "negative": grid.withColumn("units", F.when(bad, -1.0).otherwise(F.col("units"))),
        "lost product": grid.filter(F.col("product_id") != lost)}
    found = [checks.grid_preflight(frame, shop.chosen(), shop.protocol()).agg(
        F.lit(name).alias("case"), (F.count(F.lit(1)) > 0).alias("refused")) for name, frame in cases.items()]
    return reduce(DataFrame.unionByName, found)


@query("e13_forecast_simple_and_damped",
       "product_id:s model:s forecast_start:d status:s level_gain:f seasonal_gain:f trend_gain:f "
       "damping:f sse:f horizon_day:i prediction:f",
       """SELECT c.product_id, c.model, c.forecast_start, 'ok' AS status, f.a AS level_gain, f.g AS seasonal_gain,
  f.b AS trend_gain, f.d AS damping, f.rounded_sse AS sse, c.horizon_day, c.unclipped AS prediction
FROM archived_forecasts c JOIN archived_fits f USING (model, product_id, forecast_start)""")
def e13(spark, sf_dir):
    shop = shop_of(spark, sf_dir)
    both = [backtest.smoothing_fits(shop.saved_grid(), smoothing_protocol(shop, {form: None}), form)
            for form in ("ses", "hw_damped_weekly")]
    return both[0].unionByName(both[1]).select(
        "*", F.posexplode("forecast").alias("step", "prediction")).withColumn(
        "horizon_day", F.col("step") + 1)


# --- scores -------------------------------------------------------------------------


@query("f1_score", SCORES,
       """SELECT AVG(e) AS mae, 100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS wape, AVG(s) AS signed_bias,
  100 * SUM(s) / NULLIF(SUM(ABS(actual)), 0) AS percentage_bias,
  SUM(GREATEST(s, 0)) AS overprediction_units, SUM(GREATEST(-s, 0)) AS underprediction_units,
  SUM(e) AS absolute_error_sum, SUM(ABS(actual)) AS actual_units, COUNT(*) AS observations FROM errors""")
def f1(spark, sf_dir):
    return scoring.scores(predictions(spark, sf_dir))


@query("f2_relative_reduction", "product_id:s forecast_start:d reduction:f",
       """SELECT product_id, forecast_start, CASE WHEN b.wape > 0 THEN 100 * (b.wape - c.wape) / b.wape END AS reduction
FROM period_product_metrics b JOIN period_product_metrics c USING (product_id, forecast_start)
WHERE b.model = 'seasonal_naive' AND c.model = 'weekday_mean_8w'""")
def f2(spark, sf_dir):
    return scoring.product_comparisons(
        products(spark, sf_dir, "forecast_start"), [("weekday_mean_8w", "seasonal_naive")],
        P.tie_tolerance, "forecast_start",
    ).withColumnRenamed("relative_wape_reduction_pct", "reduction")


@query("f3_summaries_overall", f"model:s {SCORES} mean_product_wape:f", "SELECT * FROM overall_metrics")
def f3(spark, sf_dir):
    return scoring.overall_summaries(predictions(spark, sf_dir))


@query("f4_summaries_by_product", f"model:s product_id:s {SCORES}", "SELECT * FROM product_metrics")
def f4(spark, sf_dir):
    return products(spark, sf_dir)


@query("f5_summaries_by_period", f"forecast_start:d model:s {SCORES} mean_product_wape:f",
       "SELECT * FROM period_metrics")
def f5(spark, sf_dir):
    return scoring.overall_summaries(predictions(spark, sf_dir), "forecast_start")


@query("f5_summaries_by_period_product", f"forecast_start:d model:s product_id:s {SCORES}",
       "SELECT * FROM period_product_metrics")
def f5_products(spark, sf_dir):
    return products(spark, sf_dir, "forecast_start")


@query("f6_pairwise_comparison", PAIRWISE, "SELECT * FROM pairwise WHERE model = 'weekday_mean_4w'")
def f6(spark, sf_dir):
    pairs = scoring.pair_list([CANDIDATE], BASELINES)
    return scoring.comparison_summary(
        scoring.product_comparisons(products(spark, sf_dir), pairs, P.tie_tolerance))


@query("f7_product_outcome", DETAIL, "SELECT * FROM detail")
def f7(spark, sf_dir):
    return detail(spark, sf_dir)


@query("f8_all_pairs_comparison", PAIRWISE, "SELECT * FROM pairwise")
def f8(spark, sf_dir):
    return scoring.comparison_summary(detail(spark, sf_dir))


def period_detail(spark, sf_dir) -> DataFrame:
    return scoring.product_comparisons(
        products(spark, sf_dir, "forecast_start"), PAIRS, P.tie_tolerance, "forecast_start")


@query("f8_period_product_comparisons", f"forecast_start:d {DETAIL}", "SELECT * FROM period_detail")
def f8_period_products(spark, sf_dir):
    return period_detail(spark, sf_dir)


@query("f8_period_comparisons", f"forecast_start:d {PAIRWISE}",
       """SELECT p.*, d.wins, d.losses, d.ties, d.undefined, d.wins + d.losses + d.ties AS comparable_products,
  100.0 * d.wins / NULLIF(d.wins + d.losses + d.ties, 0) AS win_pct
FROM period_pairwise p JOIN (
  SELECT forecast_start, model, baseline, COUNT(*) FILTER (WHERE outcome = 'win') AS wins,
    COUNT(*) FILTER (WHERE outcome = 'loss') AS losses, COUNT(*) FILTER (WHERE outcome = 'tie') AS ties,
    COUNT(*) FILTER (WHERE outcome = 'undefined') AS undefined FROM period_detail GROUP BY 1, 2, 3) d
  USING (forecast_start, model, baseline)""")
def f8_periods(spark, sf_dir):
    return scoring.comparison_summary(period_detail(spark, sf_dir), "forecast_start")


@query("f8_all_pairs_smoothing", PAIRWISE, "SELECT * FROM pairwise_all WHERE model LIKE 'hw_%'")
def f8_smoothing(spark, sf_dir):
    scored = scoring.product_summaries(all_methods(spark, sf_dir))
    pairs = scoring.pair_list(P.smoothing, P.methods)
    return scoring.comparison_summary(scoring.product_comparisons(scored, pairs, P.tie_tolerance))


@query("f9_spike_threshold",
       "product_id:s forecast_start:d train_start:d train_end:d training_observations:i threshold_99:f",
       "SELECT * FROM thresholds")
def f9(spark, sf_dir):
    shop = shop_of(spark, sf_dir)
    return diagnostics.spike_thresholds(shop.saved_grid(), shop.protocol())


@query("f10_spike_label", f"model:s {DAY} actual:f spike_threshold:f is_spike:b", "SELECT * FROM labelled")
def f10(spark, sf_dir):
    return labelled(spark, sf_dir)


@query("f11_spike_summary",
       "model:s spike_product_days:i product_days:i spike_absolute_error:f total_absolute_error:f "
       "spike_error_share_pct:f",
       """SELECT model, COUNT(*) FILTER (WHERE is_spike) AS spike_product_days, COUNT(*) AS product_days,
  COALESCE(SUM(ABS(prediction - actual)) FILTER (WHERE is_spike), 0) AS spike_absolute_error,
  SUM(ABS(prediction - actual)) AS total_absolute_error,
  100 * COALESCE(SUM(ABS(prediction - actual)) FILTER (WHERE is_spike), 0)
    / NULLIF(SUM(ABS(prediction - actual)), 0) AS spike_error_share_pct
FROM labelled GROUP BY model""")
def f11(spark, sf_dir):
    return diagnostics.spike_summary(labelled(spark, sf_dir))


@query("f12_spike_examples", f"{DAY} actual:f prediction:f spike_threshold:f description:s",
       """SELECT l.*, n.description FROM (SELECT * FROM labelled WHERE model = 'weekday_mean_4w' AND is_spike
  ORDER BY actual DESC, product_id, date, forecast_start LIMIT 10) l JOIN cohort_names n USING (product_id)""")
def f12(spark, sf_dir):
    shop = shop_of(spark, sf_dir, tables.NAMED)
    return diagnostics.spike_examples(shop.backtest(), shop.names(), CANDIDATE)


_CONTRIBUTION = """SELECT d.*, n.description,
  100 * d.actual_units / NULLIF(SUM(d.actual_units) OVER w, 0) AS share_of_actual_units_pct,
  100 * d.absolute_error_sum / NULLIF(SUM(d.absolute_error_sum) OVER w, 0) AS share_of_model_error_pct,
  100 * d.error_reduction_units / NULLIF(SUM(d.error_reduction_units) OVER w, 0)
    AS share_of_net_error_reduction_pct
FROM detail d JOIN cohort_names n USING (product_id) WINDOW w AS (PARTITION BY d.model, d.baseline)"""


@query("f13_product_contributions",
       f"{DETAIL} description:s actual_units:f absolute_error_sum:f signed_bias:f "
       "share_of_actual_units_pct:f share_of_model_error_pct:f", _CONTRIBUTION)
def f13(spark, sf_dir):
    return diagnostics.product_contributions(*detail_and_names(spark, sf_dir))


@query("f14_benchmark_error_decomposition",
       "model:s baseline:s product_id:s description:s model_wape:f baseline_wape:f absolute_error_sum:f "
       "baseline_absolute_error:f error_reduction_units:f relative_wape_reduction_pct:f "
       "share_of_model_absolute_error_pct:f share_of_net_error_reduction_pct:f",
       f"SELECT *, share_of_model_error_pct AS share_of_model_absolute_error_pct FROM ({_CONTRIBUTION}) AS c")
def f14(spark, sf_dir):
    return diagnostics.error_decomposition(*detail_and_names(spark, sf_dir))


ONE_PAIR = [(CANDIDATE, COMPARATOR)]


_PAIR = "SELECT * FROM detail WHERE model = 'weekday_mean_4w' AND baseline = 'seasonal_naive'"


@query("f15_largest_improvements", "product_id:s error_reduction_units:f",
       f"{_PAIR} AND error_reduction_units > 0 ORDER BY error_reduction_units DESC, product_id LIMIT 5")
def f15(spark, sf_dir):
    return diagnostics.largest_improvements(detail(spark, sf_dir, ONE_PAIR))


@query("f15_largest_deteriorations", "product_id:s error_reduction_units:f",
       f"{_PAIR} AND error_reduction_units < 0 ORDER BY error_reduction_units, product_id LIMIT 5")
def f15_down(spark, sf_dir):
    return diagnostics.largest_deteriorations(detail(spark, sf_dir, ONE_PAIR))


@query("f16_daily_errors",
       f"{DAY} description:s model:s actual:f prediction:f absolute_error:f signed_error:f "
       "spike_threshold_units:f is_spike:b",
       """SELECT l.*, n.description, ABS(prediction - actual) AS absolute_error,
  prediction - actual AS signed_error, spike_threshold AS spike_threshold_units
FROM labelled l JOIN cohort_names n USING (product_id)""")
def f16(spark, sf_dir):
    shop = shop_of(spark, sf_dir, tables.NAMED)
    return diagnostics.daily_errors(shop.backtest(), shop.names())


_CLOSE = ("NOT COALESCE(ABS(l.{c} - r.{c}) <= 1e-8 + 1e-10 * ABS(r.{c}) OR l.{c} IS NOT DISTINCT FROM r.{c}, "
          "FALSE)")
_METRICS = ["mae", "wape", "signed_bias", "percentage_bias", "overprediction_units",
            "underprediction_units", "absolute_error_sum", "actual_units"]


def _reconcile_sql(left: str, right: str, on: str, close: list[str] = _METRICS, exact: list[str] = ["observations"]) -> str:
    """Differences per column between two tables, by full join."""
    joined = f"(SELECT l, r FROM {left} l FULL JOIN {right} r ON {on}) AS j"
    parts = [f"SELECT 'only_left' AS item, COUNT(*) FILTER (WHERE r.model IS NULL) AS differences FROM {joined}",
             f"SELECT 'only_right', COUNT(*) FILTER (WHERE l.model IS NULL) FROM {joined}"]
    for c in [*close, *exact]:
        test = _CLOSE.format(c=c) if c in close else f"l.{c} IS DISTINCT FROM r.{c}"
        parts.append(f"SELECT '{c}', COUNT(*) FILTER (WHERE l.model IS NOT NULL AND r.model IS NOT NULL AND {test}) "
                     f"FROM {joined}")
    return " UNION ALL ".join(parts)


@query("f17_metric_reconcile", "item:s differences:i", _reconcile_sql(
    "(SELECT * REPLACE (CASE model WHEN 'seasonal_naive' THEN 'weekday_mean_4w' "
    "WHEN 'weekday_mean_4w' THEN 'weekday_mean_8w' ELSE 'seasonal_naive' END AS model) FROM product_metrics)",
    "product_metrics",
    "l.model = r.model AND l.product_id = r.product_id"))
def f17(spark, sf_dir):
    """Every method under the next one's name: actuals must agree, errors need not."""
    scored = products(spark, sf_dir)
    return checks.metric_reconcile(
        scored, scored, dict(zip(BASELINES, BASELINES[1:] + BASELINES[:1])), checks.unique_key(scored, scored))


_CHANGED = """(SELECT model, forecast_start, product_id, date, horizon_day, training_observations, spike_threshold,
    actual + CASE WHEN horizon_day = 5 THEN 1 ELSE 0 END AS actual,
    prediction + CASE WHEN horizon_day = 28 THEN 0.5 WHEN horizon_day % 2 = 1 THEN 1e-9 ELSE 0 END AS prediction,
    CASE WHEN horizon_day = 2 THEN 'failure_baseline_fallback' ELSE 'ok' END AS status,
    CASE WHEN horizon_day = 1 THEN NOT is_spike ELSE is_spike END AS is_spike
  FROM labelled WHERE NOT (horizon_day = 3 AND model = 'seasonal_naive'))"""


@query("f17_prediction_reconcile", "item:s differences:i", _reconcile_sql(
    _CHANGED, "(SELECT *, 'ok' AS status FROM labelled WHERE NOT (horizon_day = 4 AND model = 'weekday_mean_4w'))",
    " AND ".join(f"l.{c} = r.{c}" for c in checks.PREDICTION_KEY),
    ["actual", "prediction", "spike_threshold"], ["horizon_day", "status", "training_observations", "is_spike"]))
def f17_predictions(spark, sf_dir):
    """Predictions worked out anew and changed in every field against the saved ones."""
    shop, day = shop_of(spark, sf_dir), F.col("horizon_day")
    protocol = shop.protocol()
    anew = backtest.window_backtest_frame(
        shop.saved_grid(), protocol, diagnostics.spike_thresholds(shop.saved_grid(), protocol))
    changed = anew.filter(~((day == 3) & (F.col("model") == "seasonal_naive"))).withColumns({
        "actual": F.col("actual") + F.when(day == 5, 1.0).otherwise(0.0),
        "prediction": F.col("prediction") + F.when(day == 28, 0.5).when(day % 2 == 1, 1e-9).otherwise(0.0),
        "status": F.when(day == 2, backtest.FAILED).otherwise(F.col("status")),
        "is_spike": F.when(day == 1, ~F.col("is_spike")).otherwise(F.col("is_spike"))})
    saved = shop.backtest().filter(~((day == 4) & (F.col("model") == "weekday_mean_4w")))
    return checks.prediction_reconcile(changed, saved)


@query("f17_saved_backtest_holds", "item:s differences:i",
       "SELECT unnest(['only_left', 'only_right', 'horizon_day', 'actual', 'prediction', 'status', 'training_observations', "
       "'spike_threshold', 'is_spike']) AS item, CASE WHEN (SELECT COUNT(*) FROM labelled) = 0 THEN 1 ELSE 0 END AS differences")
def f17_saved(spark, sf_dir):
    """The saved backtest of all methods against one worked out anew."""
    shop = shop_of(spark, sf_dir)
    protocol = shop.protocol()
    anew = backtest.window_backtest_frame(
        shop.saved_grid(), protocol, diagnostics.spike_thresholds(shop.saved_grid(), protocol),
        written(backtest.smoothing_fits(shop.saved_grid(), protocol), "fits"))
    return checks.prediction_reconcile(anew, shop.full_backtest())


@query("f18_table_reconcile", "item:s differences:i", _reconcile_sql(
    "(SELECT * REPLACE (CASE forecast_start " + " ".join(
        f"WHEN DATE '{a}' THEN DATE '{b}'" for a, b in NEXT_START.items()) +
    " END AS forecast_start) FROM period_product_metrics)", "period_product_metrics",
    "l.model = r.model AND l.product_id = r.product_id AND l.forecast_start = r.forecast_start"))
def f18(spark, sf_dir):
    """Every origin against the next one, the last against the first."""
    scored = written(products(spark, sf_dir, "forecast_start"), "period-products")
    following = F.create_map(*[F.lit(d) for pair in NEXT_START.items() for d in pair])
    moved = scored.withColumn("forecast_start", following[F.col("forecast_start")])
    return checks.table_reconcile(moved, scored, ["forecast_start", "model", "product_id"])


@query("f19_method_ranking_and_best", "model:s wape:f position:i best:b",
       """SELECT model, wape, row_number() OVER (ORDER BY wape, model) AS position,
  model = (SELECT model FROM overall_metrics ORDER BY wape, model LIMIT 1) AS best FROM overall_metrics""")
def f19(spark, sf_dir):
    """Ranked methods (a handful of rows) beside the best one from the one-pass selection."""
    overall = scoring.overall_summaries(predictions(spark, sf_dir))
    best = scoring.best_methods(overall, P.smoothing)
    placed = scoring.method_ranking(overall).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("wape").isNull().alias("undefined"), "wape", "model"))).alias("all")).select(
        F.posexplode("all").alias("at", "m"))
    return placed.select(
        "m.model", "m.wape", (F.col("at") + 1).alias("position"),
        (F.col("m.model") == best.select("best_method").scalar()).alias("best"))


@query("f20_headline_summary",
       "best_method:s candidate_wape:f comparator_wape:f candidate_absolute_error_units:f "
       "comparator_absolute_error_units:f actual_units_per_method:f relative_error_reduction_pct:f "
       "wape_difference_percentage_points:f methods:i products:i periods:i horizon_days:i prediction_rows:i "
       "raw_rows:i retained_rows:i product_count:i",
       """SELECT (SELECT model FROM overall_metrics ORDER BY wape, model LIMIT 1) AS best_method,
  c.wape AS candidate_wape, b.wape AS comparator_wape, c.absolute_error_sum AS candidate_absolute_error_units,
  b.absolute_error_sum AS comparator_absolute_error_units, c.actual_units AS actual_units_per_method,
  100 * (b.absolute_error_sum - c.absolute_error_sum) / b.absolute_error_sum AS relative_error_reduction_pct,
  b.wape - c.wape AS wape_difference_percentage_points,
  (SELECT COUNT(*) FROM overall_metrics) AS methods,
  (SELECT COUNT(DISTINCT product_id) FROM predictions) AS products,
  (SELECT COUNT(DISTINCT forecast_start) FROM predictions) AS periods,
  (SELECT COUNT(DISTINCT horizon_day) FROM predictions) AS horizon_days,
  (SELECT COUNT(*) FROM predictions) AS prediction_rows,
  (SELECT COUNT(*) FROM raw) AS raw_rows, (SELECT COUNT(*) FROM merchandise) AS retained_rows,
  (SELECT COUNT(DISTINCT product_id) FROM merchandise) AS product_count
FROM overall_metrics c, overall_metrics b WHERE c.model = 'weekday_mean_4w' AND b.model = 'seasonal_naive'""")
def f20(spark, sf_dir):
    """The headline of the saved backtest with the counts of the audit behind it."""
    shop = shop_of(spark, sf_dir)
    rows = shop.backtest()
    return diagnostics.headline_summary(scoring.overall_summaries(rows), rows, CANDIDATE, COMPARATOR).select(
        "*", F.lit(shop.fact.raw_rows).alias("raw_rows"), F.lit(shop.fact.retained_rows).alias("retained_rows"),
        F.lit(shop.fact.product_count).alias("product_count"))


def _walk_sql(name: str, direction: str, test: str) -> str:
    return f"""SELECT '{name}' AS id, p.product_id, q.forecast_start, p.actual_units, p.candidate_error,
  p.comparator_error, p.gain AS error_reduction_units,
  100 * p.candidate_error / p.actual_units AS candidate_wape,
  100 * p.comparator_error / p.actual_units AS comparator_wape, q.change AS period_error_reduction_units
FROM (SELECT product_id, SUM(actual) AS actual_units, SUM(candidate_error) AS candidate_error,
        SUM(comparator_error) AS comparator_error, SUM(comparator_error - candidate_error) AS gain
      FROM paired GROUP BY product_id HAVING SUM(actual) > 0 AND gain {test} 0
      ORDER BY gain {direction}, product_id LIMIT 1) p
JOIN (SELECT product_id, forecast_start, SUM(comparator_error - candidate_error) AS change
      FROM paired GROUP BY 1, 2) q USING (product_id)
ORDER BY q.change {direction}, q.forecast_start LIMIT 1"""


WALK = ("id:s product_id:s forecast_start:d actual_units:f candidate_error:f comparator_error:f "
        "error_reduction_units:f candidate_wape:f comparator_wape:f period_error_reduction_units:f")


@query("f21_walkthrough_improvement", WALK, _walk_sql("improvement", "DESC", ">"))
def f21(spark, sf_dir):
    paired = diagnostics.paired_errors(predictions(spark, sf_dir), CANDIDATE, COMPARATOR)
    return diagnostics.walkthrough_product(paired, True)


@query("f21_walkthrough_deterioration", WALK, _walk_sql("deterioration", "ASC", "<"))
def f21_down(spark, sf_dir):
    paired = diagnostics.paired_errors(predictions(spark, sf_dir), CANDIDATE, COMPARATOR)
    return diagnostics.walkthrough_product(paired, False)


@query("f22_walkthrough_spike", f"{DAY} actual_units:f spike_threshold:f excess_units:f",
       """SELECT *, actual AS actual_units, actual - spike_threshold AS excess_units FROM labelled
WHERE model = 'weekday_mean_4w' AND is_spike
ORDER BY actual - spike_threshold DESC, product_id, date, forecast_start LIMIT 1""")
def f22(spark, sf_dir):
    return diagnostics.walkthrough_spike(labelled(spark, sf_dir), CANDIDATE)


@query("f24_validation_model_selection", "selected_model:s validation_wape:f",
       f"""SELECT model AS selected_model, 100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS validation_wape
FROM {_STAGED} WHERE stage = 'validation' GROUP BY model ORDER BY 2, 1 LIMIT 1""")
def f24(spark, sf_dir):
    return scoring.validation_selection(staged(spark, sf_dir))


# --- views --------------------------------------------------------------------------


@query("g3_slice_by_origin_product", f"model:s {DAY} horizon_day:i actual:f prediction:f",
       "SELECT * FROM predictions WHERE forecast_start = DATE '1998-05-01' AND product_id = "
       "(SELECT product_id FROM cohort ORDER BY initial_units DESC, product_id LIMIT 1)")
def g3(spark, sf_dir):
    """The cohort's largest product under the third origin, of whose partition alone is read."""
    shop = shop_of(spark, sf_dir)
    largest = shop.chosen().orderBy(F.desc("initial_units"), "product_id").limit(1)
    return diagnostics.slice_by_origin_product(
        shop.backtest(), date(1998, 5, 1), largest.select("product_id").scalar())


@query("g5_long_series_union", f"{DAY} units:f series:s",
       """SELECT product_id, forecast_start, date, actual AS units, 'Observed sales' AS series
FROM predictions WHERE model = 'seasonal_naive'
UNION ALL SELECT product_id, forecast_start, date, prediction, model FROM predictions""")
def g5(spark, sf_dir):
    return diagnostics.long_series_union(predictions(spark, sf_dir), COMPARATOR)


@query("g6_period_pivot", "forecast_start:d " + " ".join(f"{m}:f" for m in BASELINES),
       "SELECT forecast_start, " + ", ".join(
           f"MAX(wape) FILTER (WHERE model = '{m}') AS {m}" for m in BASELINES)
       + " FROM period_metrics GROUP BY forecast_start")
def g6(spark, sf_dir):
    return diagnostics.period_pivot(
        scoring.overall_summaries(predictions(spark, sf_dir), "forecast_start"), BASELINES)


@query("g7_volume_leaders_share", "products:i share_of_actual_units_pct:f error_reduction_units:f",
       f"""SELECT COUNT(*) AS products, SUM(share_of_actual_units_pct) AS share_of_actual_units_pct,
  SUM(error_reduction_units) AS error_reduction_units
FROM (SELECT * FROM ({_CONTRIBUTION}) AS c
  WHERE model = 'weekday_mean_4w' AND baseline = 'seasonal_naive'
  ORDER BY actual_units DESC, product_id LIMIT 5) AS top""")
def g7(spark, sf_dir):
    return diagnostics.volume_leaders_share(
        diagnostics.product_contributions(*detail_and_names(spark, sf_dir, ONE_PAIR)))


@query("g8_period_win_count", "model:s baseline:s periods_won:i periods:i",
       "SELECT model, baseline, COUNT(*) FILTER (WHERE relative_wape_reduction_pct > 0) AS periods_won, "
       "COUNT(*) AS periods FROM period_pairwise GROUP BY 1, 2")
def g8(spark, sf_dir):
    return scoring.period_win_count(scoring.comparison_summary(period_detail(spark, sf_dir), "forecast_start"))


@query("g9_fit_diagnostics",
       "model:s fits:i fits_with_warnings:i fallback_fits:i clipped_observations:i",
       """SELECT model, COUNT(DISTINCT (product_id, forecast_start)) AS fits, 0 AS fits_with_warnings,
  0 AS fallback_fits, COUNT(*) FILTER (WHERE prediction - 20 < 0) AS clipped_observations
FROM predictions GROUP BY model""")
def g9(spark, sf_dir):
    records = backtest.baseline_fit_records(lowered(spark, sf_dir))
    return diagnostics.fit_diagnostics(records.withColumn("warnings", F.array().cast("array<string>")))


@query("g9_fit_diagnostics_smoothing",
       "model:s fits:i fits_with_warnings:i fallback_fits:i clipped_observations:i",
       """SELECT model, COUNT(DISTINCT (product_id, forecast_start)) AS fits,
  COUNT(DISTINCT (product_id, forecast_start)) FILTER (WHERE at_end) AS fits_with_warnings, 0 AS fallback_fits,
  COUNT(*) FILTER (WHERE unclipped < 0) AS clipped_observations FROM smooth_forecasts GROUP BY model
UNION ALL SELECT 'hw_10d', COUNT(*), 0, COUNT(*), 0 FROM cohort CROSS JOIN origins""")
def g9_smoothing(spark, sf_dir):
    """All smoothing histories, and one of ten days that falls back everywhere."""
    shop = shop_of(spark, sf_dir)
    short = smoothing_protocol(shop, {"hw_10d": 10})
    failed = backtest.fit_records(backtest.smoothing_fits(shop.saved_grid(), short), short)
    return diagnostics.fit_diagnostics(backtest.fit_records(shop.fits(), shop.protocol()).unionByName(failed))


@query("g10_distinct_top_products", "product_id:s",
       """SELECT DISTINCT product_id FROM (SELECT * FROM predictions WHERE model = 'weekday_mean_4w'
  ORDER BY actual DESC, product_id, date, forecast_start LIMIT 3) AS top""")
def g10(spark, sf_dir):
    return diagnostics.distinct_top_products(predictions(spark, sf_dir), CANDIDATE)


@query("g12_label_map_join", "model:s method:s wape:f",
       "SELECT model, wape, CASE model " + " ".join(
           f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END AS method FROM overall_metrics")
def g12(spark, sf_dir):
    return scoring.relabel(scoring.overall_summaries(predictions(spark, sf_dir)), LABELS)


@query("i2_forecast_performance", "stage:s model:s observations:i mae:f pooled_wape:f",
       f"""SELECT stage, model, COUNT(*) AS observations, AVG(e) AS mae,
  100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS pooled_wape FROM {_STAGED} GROUP BY stage, model""")
def i2(spark, sf_dir):
    return scoring.forecast_performance(staged(spark, sf_dir))


@query("i3_beat_baseline_share",
       "model:s products_beating_baseline:i comparable_products:i products_beating_baseline_pct:f",
       """SELECT model, wins AS products_beating_baseline, comparable_products,
  win_pct AS products_beating_baseline_pct FROM pairwise WHERE baseline = 'seasonal_naive'""")
def i3(spark, sf_dir):
    pairs = scoring.pair_list(BASELINES, [COMPARATOR])
    return scoring.beat_baseline_share(
        scoring.product_comparisons(products(spark, sf_dir), pairs, P.tie_tolerance))
