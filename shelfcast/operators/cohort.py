"""Product cohort chosen before a cutoff, and the forecast origins."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import count_true
from ..schemas import CohortRules, Protocol
from .facts import latest_description

NO_PRODUCTS = "no product passes the cohort rules"


def cohort_eligibility(
    sales: DataFrame, bounds: DataFrame, cutoff: date, rules: CohortRules,
) -> DataFrame:
    """History measures and the eligibility verdict per product.

    Only rows before the cutoff are read. Days are made distinct by (product, date)
    first, so counting active days needs no wide distinct set per product.
    """
    days = (
        sales.filter(F.col("date") < F.lit(cutoff))
        .groupBy("product_id", "date").agg(F.sum("units").alias("units"))
    )
    recent_from = cutoff - timedelta(days=rules.recent_days)
    history = days.groupBy("product_id").agg(
        F.min("date").alias("first_sale"),
        F.max("date").alias("last_sale"),
        F.sum("units").alias("initial_units"),
        F.count(F.lit(1)).alias("active_days"),
        count_true(F.col("date") >= F.lit(recent_from)).alias("recent_active_days"),
    )
    start = bounds.select("start").scalar()
    elapsed = F.datediff(F.lit(cutoff), start)
    initial_days = F.when(elapsed >= rules.min_initial_days, elapsed).otherwise(
        F.raise_error(F.lit("fewer days before the cutoff than the rules ask for")).cast("int"))
    active = F.col("active_days") / initial_days
    recent = F.col("recent_active_days") / F.lit(rules.recent_days)
    return history.withColumns({
        "active_day_fraction": active,
        "recent_active_day_fraction": recent,
    }).withColumn(
        "eligible",
        (F.col("first_sale") <= F.date_add(start, rules.max_first_sale_offset_days))
        & (F.col("active_day_fraction") >= rules.min_active_day_fraction)
        & (F.col("recent_active_day_fraction") >= rules.min_recent_active_day_fraction),
    )


def selected_products(eligibility: DataFrame, rules: CohortRules) -> DataFrame:
    """The eligible products with the most units; fewer than N is fine, none is an error.

    At most ``product_count`` rows, which are gathered into one list to see that there are any.
    """
    top = (
        eligibility.filter("eligible")
        .orderBy(F.desc("initial_units"), "product_id").limit(rules.product_count)
    )
    listed = top.agg(F.collect_list(F.struct(*eligibility.columns)).alias("top"))
    kind = listed.schema["top"].dataType.simpleString()
    return listed.select(F.inline(F.when(F.size("top") > 0, F.col("top")).otherwise(
        F.raise_error(F.lit(NO_PRODUCTS)).cast(kind))))


def select_cohort(eligibility: DataFrame, rules: CohortRules) -> DataFrame:
    """Every product's eligibility with a ``selected`` flag."""
    chosen = selected_products(eligibility, rules).select("product_id", F.lit(True).alias("selected"))
    return eligibility.join(F.broadcast(chosen), "product_id", "left").withColumn(
        "selected", F.coalesce("selected", F.lit(False)))


def cohort_metadata(chosen: DataFrame, sales: DataFrame, cutoff: date) -> DataFrame:
    """Selected products with their last description before the cutoff."""
    ids = F.broadcast(chosen.select("product_id"))
    known = sales.filter(F.col("date") < F.lit(cutoff)).join(ids, "product_id", "left_semi")
    return chosen.join(latest_description(known), "product_id")


def compare_cohorts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Each product id marked as shared, only in the new set or only in the old one."""
    sides = new.select("product_id", F.lit(1).alias("n"), F.lit(0).alias("o")).unionByName(
        old.select("product_id", F.lit(0).alias("n"), F.lit(1).alias("o")))
    label = (
        F.when((F.max("n") == 1) & (F.max("o") == 1), "shared")
        .when(F.max("n") == 1, "new_only").otherwise("old_only")
    )
    return sides.groupBy("product_id").agg(label.alias("membership"))


def rolling_origin_splits(spark: SparkSession, protocol: Protocol, bounds: DataFrame) -> DataFrame:
    """One row per forecast start; the horizon may not pass the observed days."""
    start, end = bounds.select("start").scalar(), bounds.select("end").scalar()
    origins = spark.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in protocol.forecast_starts])).alias("forecast_start"))
    last = F.date_add("forecast_start", protocol.horizon_days - 1)
    within = F.when(last <= end, last).otherwise(
        F.raise_error(F.lit("the last forecast day lies after the covered days")).cast("date"))
    return origins.select(
        F.date_format("forecast_start", "yyyy-MM-dd").alias("split"),
        F.lit("robustness").alias("stage"),
        start.alias("train_start"),
        F.date_sub("forecast_start", 1).alias("train_end"),
        "forecast_start",
        within.alias("forecast_end"),
        F.datediff("forecast_start", start).alias("training_days"),
        F.lit(protocol.horizon_days).alias("horizon_days"),
    )


def split_rows(spark: SparkSession, protocol: Protocol) -> DataFrame:
    """Forecast starts alone, as a constant table of known size."""
    rows = [
        F.struct(F.lit(d).alias("forecast_start"), F.lit(protocol.horizon_end(d)).alias("forecast_end"))
        for d in protocol.forecast_starts
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
