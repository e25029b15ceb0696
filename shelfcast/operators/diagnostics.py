"""Spikes, contributions, selections and headline figures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_true, percent
from ..schemas import Protocol
from .backtest import KEY

TOP_EXAMPLES = 10
TOP_PRODUCTS = 5


# --- spikes -------------------------------------------------------------------------


def spike_thresholds(grid: DataFrame, protocol: Protocol) -> DataFrame:
    """High percentile of daily units per (product, origin), zeros included.

    Exact and linearly interpolated, over the days strictly before the origin. The days of
    each product are counted by value and by the span between origins they lie in; an origin
    merges the counts of its spans. So a product is one exact histogram however many origins
    there are, and none of its days is read twice.
    """
    starts = sorted(protocol.forecast_starts)
    known = grid.filter((F.col("date") >= F.lit(protocol.expanding_start)) & (F.col("date") < F.lit(starts[-1])))
    span = F.lit(0)
    for start in starts[:-1]:
        span = span + F.when(F.col("date") >= F.lit(start), 1).otherwise(0)
    counted = known.groupBy("product_id", span.alias("span"), "units").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))
    origins = F.array(*[F.struct(F.lit(i).alias("span"), F.lit(s).alias("forecast_start")) for i, s in enumerate(starts)])
    # A value's count in an origin's history: the spans up to it added up.
    merged = counted.select("product_id", "units", "n", "first", F.explode(F.filter(
        origins, lambda o: o["span"] >= F.col("span"))).alias("o")).groupBy(
        "product_id", F.col("o.forecast_start").alias("forecast_start"), "units").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"))
    history = Window.partitionBy("product_id", "forecast_start")
    upto = history.orderBy("units").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(history).alias("all"))
    place = (F.col("all") - 1) * F.lit(protocol.spike_percentile)
    lower = F.min(F.when(F.col("upto") > F.floor(place), F.col("units")))
    upper = F.min(F.when(F.col("upto") > F.ceil(place), F.col("units")))
    part = F.max(place - F.floor(place))
    return ranked.groupBy("product_id", "forecast_start").agg(
        F.min("first").alias("train_start"), F.max("all").alias("training_observations"),
        (lower + part * (upper - lower)).alias("threshold_99"),
    ).select("product_id", "train_start", "forecast_start", F.date_sub("forecast_start", 1).alias("train_end"),
             "training_observations", "threshold_99")


def spike_summary(predictions: DataFrame) -> DataFrame:
    """Per method: labelled days and their share of absolute error."""
    error = F.abs(F.col("prediction") - F.col("actual"))
    spike = F.coalesce(F.sum(F.when(F.col("is_spike"), error)), F.lit(0.0))
    return predictions.groupBy("model").agg(
        count_true(F.col("is_spike")).alias("spike_product_days"),
        F.count(F.lit(1)).alias("product_days"),
        spike.alias("spike_absolute_error"),
        F.sum(error).alias("total_absolute_error"),
        percent(spike, F.sum(error)).alias("spike_error_share_pct"),
    )


def spike_examples(predictions: DataFrame, metadata: DataFrame, method: str) -> DataFrame:
    """The labelled days with the largest actual units under one method."""
    top = (
        predictions.filter((F.col("model") == method) & F.col("is_spike"))
        .orderBy(F.desc("actual"), "product_id", "date", "forecast_start").limit(TOP_EXAMPLES)
    )
    return top.join(metadata.select("product_id", "description"), "product_id")


def daily_errors(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    signed = F.col("prediction") - F.col("actual")
    return predictions.join(metadata.select("product_id", "description"), "product_id").select(
        "product_id", "description", "forecast_start", "date", "model", "actual", "prediction",
        F.abs(signed).alias("absolute_error"), signed.alias("signed_error"),
        F.col("spike_threshold").alias("spike_threshold_units"), "is_spike",
    )


# --- contributions --------------------------------------------------------------------


def product_contributions(detail: DataFrame, metadata: DataFrame) -> DataFrame:
    """Comparison detail with shares of actual units and of the method's error.

    Totals are one row per (method, baseline) and are broadcast back.
    """
    totals = detail.groupBy("model", "baseline").agg(
        F.sum("actual_units").alias("_units"), F.sum("absolute_error_sum").alias("_error"))
    return (
        detail.join(F.broadcast(totals), ["model", "baseline"])
        .join(metadata.select("product_id", "description"), "product_id")
        .withColumns({
            "share_of_actual_units_pct": percent(F.col("actual_units"), F.col("_units")),
            "share_of_model_error_pct": percent(F.col("absolute_error_sum"), F.col("_error")),
        })
        .drop("_units", "_error")
    )


def error_decomposition(detail: DataFrame, metadata: DataFrame) -> DataFrame:
    """How each product adds to a method's error and to its net gain over a baseline."""
    totals = detail.groupBy("model", "baseline").agg(
        F.sum("absolute_error_sum").alias("_error"), F.sum("error_reduction_units").alias("_net"))
    return (
        detail.join(F.broadcast(totals), ["model", "baseline"])
        .join(metadata.select("product_id", "description"), "product_id")
        .select(
            "model", "baseline", "product_id", "description", "model_wape", "baseline_wape",
            "absolute_error_sum", "baseline_absolute_error", "error_reduction_units",
            "relative_wape_reduction_pct",
            percent(F.col("absolute_error_sum"), F.col("_error"))
            .alias("share_of_model_absolute_error_pct"),
            percent(F.col("error_reduction_units"), F.col("_net"))
            .alias("share_of_net_error_reduction_pct"),
        )
    )


def largest_improvements(detail: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    gain = F.col("error_reduction_units")
    return detail.filter(gain > 0).orderBy(gain.desc(), "product_id").limit(n)


def largest_deteriorations(detail: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    gain = F.col("error_reduction_units")
    return detail.filter(gain < 0).orderBy(gain.asc(), "product_id").limit(n)


def volume_leaders_share(contributions: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """Joint share and gain of the products with the most actual units."""
    top = contributions.orderBy(F.desc("actual_units"), "product_id").limit(n)
    return top.agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("share_of_actual_units_pct").alias("share_of_actual_units_pct"),
        F.sum("error_reduction_units").alias("error_reduction_units"),
    )


def distinct_top_products(rows: DataFrame, method: str, n: int = 3) -> DataFrame:
    top = (
        rows.filter(F.col("model") == method)
        .orderBy(F.desc("actual"), "product_id", "date", "forecast_start").limit(n)
    )
    return top.select("product_id").distinct()


# --- headline -------------------------------------------------------------------------


def headline_summary(
    overall: DataFrame, predictions: DataFrame, candidate: str, comparator: str,
) -> DataFrame:
    """One row: candidate against comparator, and the size of the evaluation.

    Two independent routes to the relative reduction must agree, otherwise the run
    stops.
    """
    def of(model: str, field: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(field)))

    best = F.min(F.when(F.col("wape").isNotNull(), F.struct("wape", "model")))["model"]
    scored = overall.agg(
        best.alias("best_method"),
        of(candidate, "wape").alias("candidate_wape"),
        of(comparator, "wape").alias("comparator_wape"),
        of(candidate, "absolute_error_sum").alias("candidate_absolute_error_units"),
        of(comparator, "absolute_error_sum").alias("comparator_absolute_error_units"),
        of(candidate, "actual_units").alias("actual_units_per_method"),
        F.count(F.lit(1)).alias("methods"),
    )
    keys = predictions.groupBy("product_id", "forecast_start").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("days"))
    size = keys.agg(
        F.countDistinct("product_id").alias("products"),
        F.countDistinct("forecast_start").alias("periods"),
        F.max("days").alias("horizon_days"),
        F.sum("rows").alias("prediction_rows"),
    )
    by_error = percent(
        F.col("comparator_absolute_error_units") - F.col("candidate_absolute_error_units"),
        F.col("comparator_absolute_error_units"))
    by_ratio = percent(F.col("comparator_wape") - F.col("candidate_wape"), F.col("comparator_wape"))
    agree = by_error.isNull() | by_ratio.isNull() | (F.abs(by_error - by_ratio) <= 1e-10)
    checked = F.when(agree, by_error).otherwise(
        F.raise_error(F.lit("the two ways to compute the reduction differ")).cast("double"))
    counts = size.select(F.struct(*size.columns)).scalar()
    return scored.withColumns({
        **{c: counts[c] for c in size.columns},
        "relative_error_reduction_pct": checked,
        "wape_difference_percentage_points": F.col("comparator_wape") - F.col("candidate_wape"),
    })


def paired_errors(predictions: DataFrame, candidate: str, comparator: str) -> DataFrame:
    """Absolute errors of two methods side by side on the same days.

    Both methods are read in one grouping by the evaluated day; a day that lacks
    either, or on which their actuals differ, stops the run.
    """
    both = predictions.filter(F.col("model").isin(candidate, comparator))
    error = F.abs(F.col("prediction") - F.col("actual"))

    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, error))

    grouped = both.groupBy(*KEY).agg(
        F.max("actual").alias("actual"),
        F.count(F.lit(1)).alias("_n"),
        (F.min("actual") == F.max("actual")).alias("_same"),
        of(candidate).alias("_c"), of(comparator).alias("_b"),
    )
    good = (F.col("_n") == 2) & F.col("_same") & F.col("_c").isNotNull() & F.col("_b").isNotNull()
    fail = F.raise_error(F.lit("the compared methods do not share their actual values")).cast("double")
    return grouped.select(
        *KEY, "actual",
        F.when(good, F.col("_c")).otherwise(fail).alias("candidate_error"),
        F.when(good, F.col("_b")).otherwise(fail).alias("comparator_error"),
    )


def walkthrough_product(paired: DataFrame, improvement: bool) -> DataFrame:
    """The product with the most extreme gain and its most extreme period.

    Periods are summed once; products are sums of those, so the days are read once.
    """
    periods = paired.groupBy("product_id", "forecast_start").agg(
        F.sum("actual").alias("actual"),
        F.sum("candidate_error").alias("candidate_error"),
        F.sum("comparator_error").alias("comparator_error"),
    ).withColumn("change", F.col("comparator_error") - F.col("candidate_error"))
    # Sorting a signed copy ascending puts the wanted extremum first in both cases.
    sign = -1.0 if improvement else 1.0
    products = periods.groupBy("product_id").agg(
        F.sum("actual").alias("actual_units"),
        F.sum("candidate_error").alias("candidate_error"),
        F.sum("comparator_error").alias("comparator_error"),
        F.min(F.struct((F.col("change") * sign).alias("order"), "forecast_start", "change"))
        .alias("period"),
    ).withColumn("error_reduction_units", F.col("comparator_error") - F.col("candidate_error"))
    gain = F.col("error_reduction_units")
    wanted = (gain > 0) if improvement else (gain < 0)
    return (
        products.filter(wanted & (F.col("actual_units") > 0))
        .orderBy((gain * sign).asc(), "product_id").limit(1)
        .select(
            F.lit("improvement" if improvement else "deterioration").alias("id"),
            "product_id", F.col("period.forecast_start").alias("forecast_start"),
            "actual_units", "candidate_error", "comparator_error", "error_reduction_units",
            percent(F.col("candidate_error"), F.col("actual_units")).alias("candidate_wape"),
            percent(F.col("comparator_error"), F.col("actual_units")).alias("comparator_wape"),
            F.col("period.change").alias("period_error_reduction_units"),
        )
    )


def walkthrough_spike(predictions: DataFrame, method: str) -> DataFrame:
    """The labelled day that exceeds its threshold the most."""
    excess = F.col("actual") - F.col("spike_threshold")
    return (
        predictions.filter((F.col("model") == method) & F.col("is_spike"))
        .select("product_id", "forecast_start", "date", F.col("actual").alias("actual_units"),
                "spike_threshold", excess.alias("excess_units"))
        .orderBy(F.desc("excess_units"), "product_id", "date", "forecast_start").limit(1)
    )


def findings(growth: DataFrame, totals: DataFrame, weekdays: DataFrame) -> DataFrame:
    """Latest matched growth, value leader and strongest weekday, with their inputs."""
    latest = growth.filter(F.col("value_growth_pct").isNotNull()).orderBy(F.desc("year")).limit(1)
    sales = F.col("positive_sales_gbp")
    # The leader and the total come from one pass; no rank is needed.
    leader = totals.agg(
        F.min(F.when(sales.isNotNull(), F.struct((-sales).alias("lowered"), "product_id", "positive_sales_gbp")))
        .alias("first"), F.sum(sales).alias("total"),
    ).filter("first IS NOT NULL").select("first.*", "total")
    top_day = weekdays.orderBy(F.desc("average_daily_sales_gbp"), "weekday_number").limit(1)

    def row(frame: DataFrame, name: str, subject: Column, value: Column, top: Column, bottom: Column):
        return frame.select(
            F.lit(name).alias("id"), subject.cast("string").alias("subject"),
            value.cast("double").alias("value"), top.cast("double").alias("numerator"),
            bottom.cast("double").alias("denominator"))

    return (
        row(latest, "matched_growth", F.col("year"), F.col("value_growth_pct"),
            F.col("positive_sales_gbp") - F.col("previous_value"), F.col("previous_value"))
        .unionByName(row(leader, "value_leader", F.col("product_id"), sales, sales,
                         F.nullif(F.col("total").cast("double"), F.lit(0.0))))
        .unionByName(row(top_day, "weekday_pattern", F.col("weekday"),
                         F.col("average_daily_sales_gbp"), F.col("positive_sales_gbp"),
                         F.col("covered_calendar_days")))
    )


# --- views over saved frames ----------------------------------------------------------


def slice_by_origin_product(
    predictions: DataFrame, start: date, product: str | Column,
) -> DataFrame:
    """One product under one origin; prunes folders when saved by ``forecast_start``.

    The product may be a name or a scalar subquery that picks one.
    """
    return predictions.filter(
        (F.col("forecast_start") == F.lit(start)) & (F.col("product_id") == product))


def history_context(grid: DataFrame, origins: DataFrame, days: int = 90) -> DataFrame:
    """Observed days from ``days`` before each origin through the origin, both included.

    ``origins`` is the constant table of origins; each is expanded to its own days,
    which makes the lookup an equality join.
    """
    wanted = origins.select(
        "origin", F.explode(F.sequence(F.date_sub("origin", days), F.col("origin"))).alias("date"))
    return grid.join(F.broadcast(wanted), "date").select("origin", "product_id", "date", "units")


def long_series_union(predictions: DataFrame, method: str) -> DataFrame:
    """Actuals as one series and every method's predictions as further ones."""
    observed = predictions.filter(F.col("model") == method).select(
        *KEY, F.col("actual").alias("units"), F.lit("Observed sales").alias("series"))
    return observed.unionByName(
        predictions.select(*KEY, F.col("prediction").alias("units"), F.col("model").alias("series")))


def period_pivot(period_overall: DataFrame, methods: list[str]) -> DataFrame:
    """Pooled ratio by forecast start and method; the listed methods fix the columns."""
    return period_overall.groupBy("forecast_start").pivot("model", methods).agg(F.first("wape"))


def fit_diagnostics(records: DataFrame) -> DataFrame:
    return records.groupBy("model").agg(
        F.count(F.lit(1)).alias("fits"),
        count_true(F.size("warnings") > 0).alias("fits_with_warnings"),
        count_true(F.col("status") != "ok").alias("fallback_fits"),
        F.sum("negative_predictions_clipped").alias("clipped_observations"),
    )
