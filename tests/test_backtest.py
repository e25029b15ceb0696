from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from series import END, ONE_ORIGIN, ORIGIN, START, day_list, grid_of, repeating
from shelfcast.functions import smoothing
from shelfcast.operators import backtest, checks, diagnostics
from shelfcast.session import written
from shelfcast.sources import store

N = len(day_list())
HISTORY = (ORIGIN - START).days


def predicted(long, model):
    part = long.filter(F.col("model") == model).orderBy("horizon_day")
    return [r.prediction for r in part.collect()]


def test_last_week_and_weekday_means(spark):
    values = [999.0] * (HISTORY - 56) + [float(i) for i in range(1, 57)] + [0.0] * 28
    long = backtest.backtest_long_frame(grid_of(spark, values), ONE_ORIGIN)
    assert predicted(long, "seasonal_naive") == [float(v) for v in range(50, 57)] * 4
    last = np.arange(29, 57, dtype=float).reshape(4, 7).mean(axis=0)
    assert predicted(long, "weekday_mean_4w") == list(np.tile(last, 4))
    eight = np.arange(1, 57, dtype=float).reshape(8, 7).mean(axis=0)
    assert predicted(long, "weekday_mean_8w") == list(np.tile(eight, 4))
    row = long.orderBy("horizon_day").first()
    assert row.train_last_date == row.origin == date(2010, 12, 31) and row.horizon_day == 1
    assert long.count() == 3 * 28


@pytest.mark.parametrize("days, message", [
    (range(HISTORY - 10, N), "too few days of history"),
    (range(0, N - 1), "no actual value"),
])
def test_short_history_and_missing_actuals_stop_the_run(spark, days, message):
    grid = grid_of(spark, repeating()).filter(
        F.col("date").isin([START + timedelta(days=i) for i in days]))
    with pytest.raises(PySparkException, match=message):
        backtest.backtest_long_frame(grid, ONE_ORIGIN).collect()


@pytest.fixture(scope="module")
def window_frames(spark):
    """Two runs that differ only from the origin on."""
    out = []
    for after in (None, 99999.0):
        values = repeating()
        if after is not None:
            values[HISTORY:] = [after] * (N - HISTORY)
        grid = grid_of(spark, values)
        fits = written(backtest.smoothing_fits(grid, ONE_ORIGIN), "test-fits")
        thresholds = diagnostics.spike_thresholds(grid, ONE_ORIGIN)
        frame = written(backtest.window_backtest_frame(grid, ONE_ORIGIN, thresholds, fits), "test-frame")
        out.append((frame, fits, thresholds))
    return out


def test_six_methods_share_support_and_bounds(spark, window_frames):
    frame, fits, thresholds = window_frames[0]
    assert frame.count() == 6 * 28
    observed = {r.model: r.n for r in frame.groupBy("model").agg(
        F.max("training_observations").alias("n")).collect()}
    assert observed == {"hw_expanding": 396, "hw_182d": 182, "hw_365d": 365, "seasonal_naive": 7,
                        "weekday_mean_4w": 28, "weekday_mean_8w": 56}
    assert {r.train_start for r in fits.filter("model = 'hw_182d'").collect()} == {
        ORIGIN - timedelta(days=182)}
    assert thresholds.first().training_observations == 396
    ids = spark.createDataFrame([("example",)], "product_id string")
    assert checks.support_validation(frame, ids, ONE_ORIGIN.methods, ONE_ORIGIN).isEmpty()
    # A series that repeats every week is forecast without error by every method.
    assert frame.filter("abs(prediction - actual) > 1e-6").isEmpty()


def test_nothing_after_the_origin_changes_a_forecast_or_threshold(window_frames):
    (a, _, ta), (b, _, tb) = window_frames
    keys = ["model", "product_id", "date", "prediction", "spike_threshold", "status"]
    assert a.select(keys).exceptAll(b.select(keys)).isEmpty()
    assert ta.exceptAll(tb).isEmpty()
    assert not a.select("model", "date", "actual").exceptAll(b.select("model", "date", "actual")).isEmpty()


def test_spikes_lie_strictly_above_the_threshold(spark):
    for after, spikes in ((1.0, 28), (0.0, 0)):
        grid = grid_of(spark, [0.0] * HISTORY + [after] * (N - HISTORY))
        thresholds = diagnostics.spike_thresholds(grid, ONE_ORIGIN)
        assert thresholds.first().threshold_99 == 0
        frame = backtest.window_backtest_frame(grid, ONE_ORIGIN, thresholds)
        assert frame.filter("is_spike and model = 'seasonal_naive'").count() == spikes


def test_failed_fits_stay_in_the_scores_with_the_last_week(spark):
    grid = grid_of(spark, repeating())
    fits = backtest.smoothing_fits(grid, ONE_ORIGIN)
    bad = fits.withColumn("status", F.when(F.col("model") == "hw_182d", backtest.FAILED)
                          .when(F.col("model") == "hw_365d", backtest.NOT_CONVERGED).otherwise("ok"))
    bad = bad.withColumn("forecast", F.when(F.col("model") == "hw_182d", F.lit(None)).otherwise(
        F.transform("forecast", lambda v: F.lit(-2.0))))
    bad = written(bad, "bad-fits")
    long = backtest.backtest_long_frame(grid, ONE_ORIGIN, bad)
    naive = predicted(long, "seasonal_naive")
    assert predicted(long, "hw_182d") == naive and predicted(long, "hw_365d") == naive
    assert predicted(long, "hw_expanding") == [0.0] * 28
    assert long.count() == 6 * 28
    records = {r.model: r for r in backtest.fit_records(bad, ONE_ORIGIN).collect()}
    assert records["hw_expanding"].negative_predictions_clipped == 28
    assert records["hw_182d"].negative_predictions_clipped == 0
    assert {r.model for r in backtest.fit_events(backtest.fit_records(bad, ONE_ORIGIN)).collect()} == set(
        ONE_ORIGIN.smoothing)
    counts = {r.model: r for r in diagnostics.fit_diagnostics(backtest.fit_records(bad, ONE_ORIGIN)).collect()}
    assert counts["hw_182d"].fallback_fits == 1 and counts["hw_expanding"].clipped_observations == 28


def python_fits(y, form):
    """Every set of coefficients by a plain loop: (rounded error, gains, forecast)."""
    out = []
    for a, b, g, d in smoothing.FORMS[form]:
        level, trend, sse = sum(y[:14]) / 14.0, 0.0, 0.0
        season = [(y[k] + y[k + 7]) / 2.0 - level for k in range(7)] if form != "ses" else [0.0] * 7
        for v in y:
            base, old = level + d * trend, level
            e = v - base - season[0]
            sse += e * e
            level = a * (v - season[0]) + (1.0 - a) * base
            trend = b * (level - old) + (1.0 - b) * d * trend
            season = [*season[1:], g * (v - base) + (1.0 - g) * season[0]]
        ahead = [level + sum(d ** (i + 1) for i in range(h + 1)) * trend + season[h % 7] for h in range(28)]
        out.append((round(sse, 6), (a, b, g, d), ahead))
    return out


def spark_fits(spark, histories, form):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(histories)], "i int, history array<double>")
    fault = smoothing.history_fault(F.col("history"))
    found = rows.select("i", F.inline(F.array(F.struct(fault.alias("error"), F.when(
        fault.isNull(), smoothing.best_fit(F.col("history"), form)).alias("fit"))))).select(
        "i", "error", "fit.sse", "fit.gains", F.when(F.col("fit").isNotNull(), smoothing.forecasts(F.col("fit"), 28)).alias("ahead"))
    return sorted(found.collect())


@pytest.mark.parametrize("form", list(smoothing.FORMS))
def test_smoothing_picks_the_best_of_all_coefficients(spark, form):
    rng = np.random.default_rng(4)
    histories = [(rng.poisson(6, n) + np.resize([0, 1, 2, 3, 4, 8, 0], n) + np.cumsum(rng.normal(0, 0.4, n))).tolist()
                 for n in (14, 15, 60, 210)]
    histories += [[0.0] * 40, [3.0] * 30, (50 + 2.0 * np.arange(60)).tolist()]
    for row, y in zip(spark_fits(spark, histories, form), histories):
        best = min(python_fits(y, form), key=lambda f: f[:2])
        assert row.error is None and row.sse == pytest.approx(best[0], abs=2e-6)
        assert tuple(row.gains) == best[1] and row.ahead == pytest.approx(best[2])


def test_unfit_histories_carry_their_reason(spark):
    histories = [[1.0] * 13, [1.0, None] * 20, [1.0, float("nan")] * 20, [1.0, float("inf")] * 20, [], [2.0] * 14]
    rows = spark_fits(spark, histories, "hw_weekly")
    assert [r.error for r in rows] == [
        smoothing.TOO_SHORT, *[smoothing.NOT_FINITE] * 3, smoothing.TOO_SHORT, None]
    assert all(r.ahead is None for r in rows[:-1]) and rows[-1].ahead == [2.0] * 28


def test_a_fit_that_fails_leaves_the_others(spark):
    short = replace(ONE_ORIGIN, smoothing={"hw_10d": 10, "hw_182d": 182})
    grid = grid_of(spark, repeating())
    fits = {r.model: r for r in backtest.smoothing_fits(grid, short).collect()}
    assert fits["hw_10d"].status == backtest.FAILED and fits["hw_10d"].forecast is None
    assert fits["hw_182d"].status == backtest.OK and len(fits["hw_182d"].forecast) == 28
    long = backtest.backtest_long_frame(grid, short, backtest.smoothing_fits(grid, short))
    assert predicted(long, "hw_10d") == predicted(long, "seasonal_naive")
    assert long.filter("model = 'hw_10d'").select("status").distinct().first()[0] == backtest.FAILED


def test_fits_are_worked_out_once(spark):
    """No filter or projection may repeat the fold over a history."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        fits = backtest.smoothing_fits(grid_of(spark, repeating()), ONE_ORIGIN)
        plan = fits.select("*", F.posexplode("forecast"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert sum("array_min(" in line for line in plan.split("\n")) == 1


def test_history_sums_from_running_sums(spark):
    values = [float(v) for v in np.random.default_rng(2).integers(0, 9, N)]
    got = {(r.model): (r.train_start, r.train_end, r.training_observations, r.history_units)
           for r in backtest.history_sums(grid_of(spark, values), ONE_ORIGIN).collect()}
    for model, window in {**ONE_ORIGIN.smoothing, **ONE_ORIGIN.baselines}.items():
        n = window or HISTORY
        assert got[model] == (ORIGIN - timedelta(days=n), ORIGIN - timedelta(days=1), n, sum(values[HISTORY - n:HISTORY]))
    with pytest.raises(PySparkException, match="too few days"):
        backtest.history_sums(grid_of(spark, values).filter(F.col("date") != F.lit(ORIGIN - timedelta(days=20))), ONE_ORIGIN).collect()


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.99, 1.0])
def test_thresholds_of_growing_histories_are_exact(spark, percentile):
    rng = np.random.default_rng(6)
    protocol = replace(ONE_ORIGIN, forecast_starts=tuple(ORIGIN + timedelta(days=d) for d in (-40, -20, 0)), spike_percentile=percentile)
    for values in (rng.poisson(1, N).astype(float), np.zeros(N), rng.normal(size=N)):
        found = {r.forecast_start: r for r in diagnostics.spike_thresholds(grid_of(spark, values.tolist()), protocol).collect()}
        assert len(found) == 3
        for start, r in found.items():
            known = values[: (start - START).days]
            assert r.training_observations == len(known) and r.train_start == START and r.train_end == start - timedelta(days=1)
            assert r.threshold_99 == pytest.approx(np.quantile(known, percentile))


def problem_grid(spark, kind):
    grid, day = grid_of(spark, repeating()), START + timedelta(days=20)
    if kind == "gap":
        return grid.filter(F.col("date") != F.lit(day))
    if kind == "duplicate":
        return grid.unionByName(grid.filter(F.col("date") == F.lit(day)))
    if kind == "negative":
        return grid.withColumn("units", F.when(F.col("date") == F.lit(day), -1.0).otherwise(F.col("units")))
    return grid.filter(F.col("date") >= F.lit(START + timedelta(days=100)))


@pytest.mark.parametrize("kind, check, count", [
    ("gap", "incomplete_calendar", 1), ("duplicate", "duplicate_product_day", 2),
    ("negative", "invalid_units", 1), ("short", "incomplete_calendar", 100)])
def test_preflight_names_each_problem(spark, kind, check, count):
    ids = spark.createDataFrame([("example",)], "product_id string")
    found = checks.grid_preflight(problem_grid(spark, kind), ids, ONE_ORIGIN)
    assert [(r.check, r.rows) for r in found.collect()] == [(check, count)]
    with pytest.raises(ValueError, match=check):
        checks.require_none(found)


def test_preflight_population_and_history(spark):
    grid = grid_of(spark, repeating())
    ids = spark.createDataFrame([("example",), ("other",)], "product_id string")
    found = checks.grid_preflight(grid, ids, ONE_ORIGIN).collect()
    assert {(r.check, r.product_id) for r in found} == {("changed_population", "other")}
    fine = checks.grid_preflight(grid, ids.filter("product_id = 'example'"), ONE_ORIGIN)
    checks.require_none(fine)
    with pytest.raises(ValueError, match="fewer days before it"):
        checks.grid_preflight(grid, ids, replace(ONE_ORIGIN, expanding_start=date(2010, 6, 1)))


def test_support_validation_names_each_problem(spark, window_frames):
    frame = window_frames[0][0]
    ids = spark.createDataFrame([("example",)], "product_id string")

    def found(changed):
        rows = checks.support_validation(changed, ids, ONE_ORIGIN.methods, ONE_ORIGIN).collect()
        return {(r.check, r.rows) for r in rows}

    day = F.lit(ORIGIN)
    one = (F.col("model") == "hw_182d") & (F.col("date") == day)
    assert found(frame.unionByName(frame.filter(one))) == {("duplicate_key", 1)}
    assert found(frame.filter(~one)) == {("method_coverage", 1)}
    assert found(frame.filter(F.col("date") != day)) == {("horizon_coverage", 1)}
    assert found(frame.withColumn("actual", F.when(one, 7.5).otherwise(F.col("actual")))) == {
        ("support_differs", 1)}
    assert found(frame.withColumn("horizon_day", F.when(one, 9).otherwise(F.col("horizon_day")))) == {
        ("not_consecutive", 1)}
    assert END == ORIGIN + timedelta(days=27)


def test_clipped_days_are_counted_before_the_floor(spark):
    values = [v - 4 for v in repeating()]
    grid = grid_of(spark, values)
    frame = backtest.window_backtest_frame(grid, ONE_ORIGIN, diagnostics.spike_thresholds(grid, ONE_ORIGIN))
    counts = {r.model: r.negative_predictions_clipped for r in backtest.baseline_fit_records(frame).collect()}
    assert counts == dict.fromkeys(ONE_ORIGIN.baselines, 12)
    assert frame.filter("prediction < 0").count() == 0


def test_faulty_rows_and_failed_checks_leave_no_saved_result(spark, tmp_path):
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, units double")
    bad = {"a negative amount": F.col("units") < 0}

    def saved(rows, parameters=1, **options):
        return store.stored_by(spark, str(tmp_path), parameters, "rows", lambda: rows, faults=bad, **options)

    with pytest.raises(ValueError, match="a negative amount"):
        saved(good.withColumn("units", F.col("units") - 1.5))
    with pytest.raises(ValueError, match="Structural checks failed"):
        saved(good, check=lambda rows: checks.require_none(rows.filter("units > 1")))
    assert {tuple(r) for r in saved(good, partitions=("model",)).select("model", "units").collect()} == {("a", 1.0), ("b", 2.0)}
    # Found again without being built, and one partition alone is read.
    again = store.stored_by(spark, str(tmp_path), 1, "rows", None, partitions=("model",)).filter("model = 'b'")
    assert "PartitionFilters: [isnotnull(model" in again._jdf.queryExecution().executedPlan().toString()
    assert [r.units for r in again.collect()] == [2.0]
