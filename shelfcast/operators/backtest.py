"""Rolling-origin forecasts from a dense daily grid."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_true
from ..functions.smoothing import AT_END, LEVELS, SEASON, best_fit, forecasts, history_fault
from ..schemas import Protocol
from ..session import fit_partitions
from .cohort import split_rows

OK = "ok"
NOT_CONVERGED = "nonconverged_baseline_fallback"
FAILED = "failure_baseline_fallback"
NAIVE = "seasonal_naive"
KEY = ["product_id", "forecast_start", "date"]


def _or_fail(ok: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


# --- histories ------------------------------------------------------------------


def training_windows(spark: SparkSession, protocol: Protocol) -> DataFrame:
    """First and last training day per origin and method, ending the day before it."""
    rows = []
    for method, window in {**protocol.smoothing, **protocol.baselines}.items():
        for start in protocol.forecast_starts:
            first = protocol.expanding_start if window is None else start - timedelta(days=window)
            if first < protocol.expanding_start:
                raise ValueError("a history would start before the first covered day")
            rows.append(F.struct(
                F.lit(method).alias("model"),
                F.lit(start).alias("forecast_start"),
                F.lit(first).alias("train_start"),
                F.lit(start - timedelta(days=1)).alias("train_end"),
                F.lit((start - first).days).alias("training_observations"),
            ))
    return spark.range(1).select(F.inline(F.array(*rows)))


def history_sums(grid: DataFrame, protocol: Protocol) -> DataFrame:
    """Days and units of every method's history, per (product, origin).

    Each grid day is read once for its running sums; a history of any length is the
    difference of the sums at its last day and before its first. A short one stops the run.
    """
    running = Window.partitionBy("product_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = grid.select("product_id", "date", F.sum("units").over(running).alias("sum"), F.count("units").over(running).alias("n"))
    windows = training_windows(grid.sparkSession, protocol)
    ends = F.array(F.struct(F.col("train_end").alias("date"), F.lit(1).alias("sign")),
                   F.struct(F.date_sub("train_start", 1).alias("date"), F.lit(-1).alias("sign")))
    listed = windows.select("*", F.inline(ends))  # two rows per origin and method
    found = sums.join(F.broadcast(listed), "date").groupBy(
        "product_id", "model", "forecast_start", "train_start", "train_end", "training_observations").agg(
        F.sum(F.col("sign") * F.col("sum")).alias("history_units"), F.sum(F.col("sign") * F.col("n")).alias("days"))
    whole = F.col("days") == F.col("training_observations")
    return found.withColumn("history_units", _or_fail(
        whole, F.col("history_units"), "a history has too few days", "double")).drop("days")


# --- weekday baselines ----------------------------------------------------------


def baseline_support(grid: DataFrame, protocol: Protocol) -> DataFrame:
    """Every evaluated day with its actual and one column per baseline forecast.

    The days an origin needs (its longest baseline history and its horizon) form a
    constant table, so history and horizon meet the grid in one broadcast equality
    join on the date and one aggregation per (product, origin, weekday); the
    horizon days ride along in the same group. A short history stops the run.
    """
    longest, horizon = protocol.longest_baseline, protocol.horizon_days
    if any(w % SEASON for w in protocol.baselines.values()):
        raise ValueError("Baseline histories must be whole weeks")
    needed = split_rows(grid.sparkSession, protocol).select(
        "forecast_start", "forecast_end",
        F.explode(F.sequence(F.date_sub("forecast_start", longest), F.col("forecast_end"))).alias("date"),
    ).withColumn("offset", F.datediff("date", "forecast_start"))
    slot = F.pmod("offset", F.lit(SEASON))
    ahead = F.col("offset") >= 0

    aggs = [F.collect_list(F.when(ahead, F.struct("offset", "date", "units"))).alias("days")]
    for name, window in protocol.baselines.items():
        within = ~ahead & (F.col("offset") >= -window)
        aggs += [F.avg(F.when(within, F.col("units"))).alias(name),
                 F.count_if(within).alias(f"{name}_n")]
    weekdays = (
        grid.join(F.broadcast(needed), "date")
        .groupBy("product_id", "forecast_start", "forecast_end", slot.alias("slot")).agg(*aggs)
    )
    expected = F.floor((F.lit(horizon - 1) - F.col("slot")) / SEASON) + 1
    kind = weekdays.schema["days"].dataType.simpleString()
    checked = weekdays.withColumns({
        "days": _or_fail(F.size("days") == expected, F.col("days"),
                         "an evaluated day has no actual value", kind),
        **{name: _or_fail(F.col(f"{name}_n") == window // SEASON, F.col(name),
                          "a weekday has too few days of history", "double")
           for name, window in protocol.baselines.items()},
    })
    return checked.select(
        "product_id", "forecast_start", "forecast_end",
        F.inline("days"), *protocol.baselines,
    ).select(
        "product_id", "forecast_start", "forecast_end", "date",
        (F.col("offset") + 1).alias("horizon_day"), F.col("units").alias("actual"),
        *protocol.baselines,
    )


def baseline_forecasts(support: DataFrame, protocol: Protocol) -> DataFrame:
    """Long form: one row per (product, origin, method, day)."""
    names = list(protocol.baselines)
    keep = [c for c in support.columns if c not in names]
    return support.unpivot(keep, names, "model", "prediction").withColumn("status", F.lit(OK))


def clip_nonnegative(value: Column, protocol: Protocol) -> Column:
    return F.greatest(value, F.lit(0.0)) if protocol.clip_at_zero else value


# --- weekly smoothing -----------------------------------------------------------


def history_slices(grid: DataFrame, protocol: Protocol, methods: dict[str, int | None]) -> DataFrame:
    """``history``: the units of the days before an origin, per (product, origin, method).

    A product's days are gathered once; every history is a slice of them.
    """
    last = F.lit(max(protocol.forecast_starts) - timedelta(days=1))
    days = grid.filter(F.col("date").between(F.lit(protocol.expanding_start), last)).groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("date", "units"))).alias("days"))
    whole = F.size("days") == F.datediff(last, F.lit(protocol.expanding_start)) + 1
    whole &= F.size(F.array_distinct("days.date")) == F.size("days")
    windows = training_windows(grid.sparkSession, replace(protocol, smoothing=methods, baselines={})).withColumn(
        "offset", F.datediff("train_start", F.lit(protocol.expanding_start)))
    listed = windows.agg(F.collect_list(F.struct(*windows.columns))).scalar()
    units = _or_fail(whole, F.col("days.units"), "the grid skips or repeats a day", "array<double>")
    return days.select("product_id", units.alias("units"), F.explode(listed).alias("w")).select(
        "product_id", "w.forecast_start", "w.model", "w.train_start", "w.train_end", "w.training_observations",
        F.slice("units", F.col("w.offset") + 1, F.col("w.training_observations")).alias("history"))


def smoothing_fits(grid: DataFrame, protocol: Protocol, form: str = "hw_weekly") -> DataFrame:
    """One row per (product, origin, smoothing history) with its forecast.

    A row holds one history, whatever the number of lines behind it, and is folded where it
    stands, once for each set of coefficients. The partition count is fixed so that small
    rows do not end up in a single task. A history that cannot be fitted has a failed status
    and no forecast.
    """
    slices = history_slices(grid, protocol, dict(protocol.smoothing)).repartition(
        fit_partitions(grid.sparkSession), "product_id", "model", "forecast_start")
    fault = history_fault(F.col("history"))
    # Made by a generator of one row, so that no filter or projection above repeats the fits.
    tried = slices.select("*", F.inline(F.array(F.struct(
        fault.alias("error"), F.when(fault.isNull(), best_fit(F.col("history"), form)).alias("fit")))))
    found = F.transform(F.array("fit"), lambda fit: F.struct(
        fit["gains"].alias("gains"), fit["sse"].alias("sse"), forecasts(fit, protocol.horizon_days).alias("forecast")))[0]
    at_end = F.col("f.gains.level_gain") == LEVELS[-1]
    return tried.select("*", F.when(F.col("fit").isNotNull(), found).alias("f")).select(
        "product_id", "forecast_start", "model", "train_start", "train_end", "training_observations",
        F.when(F.col("error").isNull(), OK).otherwise(FAILED).alias("status"),
        F.when(at_end, F.array(F.lit(AT_END))).otherwise(F.array().cast("array<string>")).alias("warnings"), "error",
        "f.gains.level_gain", "f.gains.seasonal_gain", "f.gains.trend_gain", "f.gains.damping", "f.sse", "f.forecast")


def fallback_prediction(status: Column, prediction: Column, naive: Column) -> Column:
    """The model's own value while its fit stands, otherwise the last-week repeat."""
    return F.when(status == OK, prediction).otherwise(naive)


def smoothing_forecasts(fits: DataFrame, support: DataFrame, protocol: Protocol) -> DataFrame:
    """Long form of the fits, joined to the evaluated days, with the fallback applied.

    Failed fits keep their days: they are scored with the last-week repeat.
    """
    days = fits.select(
        "product_id", "forecast_start", "model", "train_start", "training_observations", "status",
        "forecast",
    ).join(support, ["product_id", "forecast_start"])
    own = F.element_at("forecast", F.col("horizon_day"))
    return days.withColumn(
        "unclipped", fallback_prediction(F.col("status"), own, F.col(NAIVE)),
    ).withColumn("prediction", clip_nonnegative(F.col("unclipped"), protocol)).drop(
        "forecast", *protocol.baselines)


# --- long frames ----------------------------------------------------------------


def backtest_long_frame(
    grid: DataFrame, protocol: Protocol, fits: DataFrame | None = None,
) -> DataFrame:
    """Predictions of the baselines and, when fits are given, of their methods.

    ``unclipped`` keeps the value before the floor, from which clipped days are counted.
    """
    support = baseline_support(grid, protocol)
    long = baseline_forecasts(support, protocol).withColumn("unclipped", F.col("prediction")).withColumn(
        "prediction", clip_nonnegative(F.col("unclipped"), protocol))
    if fits is not None:
        smooth = smoothing_forecasts(fits, support, protocol)
        long = long.unionByName(smooth.select(*long.columns))
    origin = F.date_sub("forecast_start", 1)
    return long.select(
        F.lit("robustness").alias("stage"),
        F.date_format("forecast_start", "yyyy-MM-dd").alias("split"),
        "product_id", "model", origin.alias("origin"), origin.alias("train_last_date"), "date",
        "forecast_start", "forecast_end", "horizon_day", "actual", "prediction", "unclipped", "status",
    )


def window_backtest_frame(
    grid: DataFrame, protocol: Protocol, thresholds: DataFrame, fits: DataFrame | None = None,
) -> DataFrame:
    """As the long frame, with training bounds, spike threshold and label.

    Bounds come from a constant table; thresholds hold one row per (product, origin).
    """
    bounds = training_windows(grid.sparkSession, protocol).select(
        "model", "forecast_start", "train_start", "training_observations")
    return (
        backtest_long_frame(grid, protocol, fits)
        .join(F.broadcast(bounds), ["model", "forecast_start"])
        .join(thresholds.select("product_id", "forecast_start",
                                F.col("threshold_99").alias("spike_threshold")),
              ["product_id", "forecast_start"])
        .select(
            F.lit(protocol.experiment).alias("experiment"), "model", "product_id",
            "forecast_start", "forecast_end", "date", "origin", "train_last_date", "train_start",
            "training_observations", "horizon_day", "actual", "prediction", "unclipped", "status",
            "spike_threshold", (F.col("actual") > F.col("spike_threshold")).alias("is_spike"),
        )
    )


def baseline_fit_records(predictions: DataFrame) -> DataFrame:
    """One row per (method, product, origin) with bounds, status and clipped days."""
    return predictions.groupBy("model", "product_id", "forecast_start").agg(
        F.min("train_start").alias("train_start"),
        F.max("train_last_date").alias("train_end"),
        F.max("training_observations").alias("training_observations"),
        F.max("status").alias("status"),
        count_true(F.col("unclipped") < 0).alias("negative_predictions_clipped"),
    )


def fit_records(fits: DataFrame, protocol: Protocol) -> DataFrame:
    """Bounds, status, warnings and clipped days of every smoothing fit."""
    negative = F.coalesce(F.size(F.filter("forecast", lambda v: v < 0)), F.lit(0))
    return fits.select(
        "model", "product_id", "forecast_start", "train_start", "train_end",
        "training_observations", "status", "warnings", "error",
        F.when(F.col("status") == OK, negative).otherwise(0).cast("long")
        .alias("negative_predictions_clipped"),
    )


def fit_events(records: DataFrame) -> DataFrame:
    """Only the fits worth a note: a fallback, a warning or a clipped day."""
    return records.filter(
        (F.col("status") != OK) | (F.size("warnings") > 0)
        | (F.col("negative_predictions_clipped") > 0))
