"""Product/day facts, dimensions, calendar and dense series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_true, money
from ..schemas import DEFAULT_DESCRIPTION


def product_day_sales(lines: DataFrame) -> DataFrame:
    """Units, value, line count and, where lines carry one, the last description.

    One row per product and day. Line value is taken before aggregation. The last wording rides
    along as one value a group, so lines are shuffled once, after every task has combined its
    own: a product holding a third of all lines reaches the shuffle as one row per task and
    day. ``copies`` weights lines that stand for several.
    """
    units, value, count = F.col("units"), money(F.col("units") * F.col("unit_price")), F.count(F.lit(1))
    if "copies" in lines.columns:
        copies = F.col("copies")
        units, value, count = units * copies, value * copies, F.sum(copies)
    sums = [
        F.sum(units).alias("units"),
        F.sum(value).cast("decimal(38,4)").alias("positive_sales_gbp"),
        count.alias("transaction_lines"),
    ]
    if "description" not in lines.columns:
        return lines.groupBy("product_id", "date").agg(*sums)
    described = F.when(F.col("description").isNotNull(), F.struct("last_position", "description"))
    return lines.groupBy("product_id", "date").agg(*sums, F.max(described).alias("_last")).select(
        "product_id", "date", "units", "positive_sales_gbp", "transaction_lines",
        F.col("_last.description").alias("description"))


def latest_description(sales: DataFrame) -> DataFrame:
    """Most recent description per product, or the default text."""
    worded = sales.groupBy("product_id", "description").agg(F.max("date").alias("date"))
    described = F.when(F.col("description").isNotNull(), F.struct("date", "description"))
    return worded.groupBy("product_id").agg(
        F.coalesce(F.max(described)["description"], F.lit(DEFAULT_DESCRIPTION)).alias("description"))


def product_dimension(sales: DataFrame) -> DataFrame:
    """One row per retained product.

    The fact already carries the last description of each day, so this reads the
    fact and not the lines. Every product of the fact is present by construction.
    """
    return latest_description(sales)


def calendar(bounds: DataFrame) -> DataFrame:
    """Every day from ``start`` to ``end`` with month and weekday attributes."""
    days = bounds.select("start", "end", F.explode(F.sequence("start", "end")).alias("date"))
    month_start = F.trunc("date", "month")
    return days.select(
        "date",
        month_start.alias("month_start"),
        F.weekday("date").alias("weekday_number"),
        F.date_format("date", "EEEE").alias("weekday"),
        ((month_start >= F.col("start")) & (F.last_day("date") <= F.col("end"))).alias("complete_month"),
    )


def daily_totals(sales: DataFrame, days: DataFrame) -> DataFrame:
    """Totals for every calendar date, zero where nothing was sold.

    The per-day sums hold at most one row per date, which bounds the broadcast.
    """
    per_day = sales.groupBy("date").agg(
        F.sum("units").alias("units"),
        F.sum("positive_sales_gbp").alias("positive_sales_gbp"),
        F.sum("transaction_lines").alias("transaction_lines"),
    )
    return days.select("date").join(F.broadcast(per_day), "date", "left").select(
        "date",
        F.coalesce("units", F.lit(0.0)).alias("units"),
        F.coalesce("positive_sales_gbp", F.lit(0)).alias("positive_sales_gbp"),
        F.coalesce("transaction_lines", F.lit(0)).alias("transaction_lines"),
    )


def dense_daily_grid(sales: DataFrame, products: DataFrame, days: DataFrame) -> DataFrame:
    """Units for every listed product and calendar day, zeros explicit.

    Every day with sales also gives the days without that lie before it, and a product's last
    one those behind it, so the grid is a window over a product's own days and needs no join
    with the calendar; a fact in buckets of products is not shuffled for it. Products without
    any sales get a calendar of zeros.
    """
    ids = products.select("product_id")
    span = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    sold = sales.join(ids, "product_id", "left_semi").filter(F.col("date").between(first, last)).groupBy(
        "product_id", "date").agg(F.sum("units").alias("units"))
    ordered = Window.partitionBy("product_id").orderBy("date")
    gaps = sold.select(
        "product_id", F.col("date").alias("sold_on"), "units", F.lag("date").over(ordered).alias("before"),
        F.lead("date").over(ordered).alias("after"))
    leading = F.sequence(F.coalesce(F.date_add("before", 1), first), F.col("sold_on"))
    behind = F.when(F.col("after").isNull() & (F.col("sold_on") < last), F.sequence(F.date_add("sold_on", 1), last))
    none = F.array().cast("array<date>")
    grid = gaps.select("product_id", "sold_on", "units", F.explode(F.concat(leading, F.coalesce(behind, none))).alias("date")).select(
        "product_id", "date", F.when(F.col("date") == F.col("sold_on"), F.coalesce("units", F.lit(0.0))).otherwise(0.0).alias("units"))
    unsold = ids.distinct().join(sold.select("product_id"), "product_id", "left_anti").select(
        "product_id", F.explode(F.sequence(first, last)).alias("date"), F.lit(0.0).alias("units"))
    return grid.unionByName(unsold)


def sales_summary(grid: DataFrame, days: int = 7) -> DataFrame:
    """Per product: total, daily mean, highest trailing sum and active days.

    The window runs over one product's calendar days.
    """
    trailing = Window.partitionBy("product_id").orderBy("date").rowsBetween(1 - days, 0)
    return (
        grid.withColumn("trailing", F.sum("units").over(trailing))
        .groupBy("product_id")
        .agg(
            F.sum("units").alias("observed_units"),
            F.avg("units").alias("average_daily_units"),
            F.max("trailing").alias("peak_7_day_units"),
            count_true(F.col("units") > 0).alias("active_days"),
        )
    )


def active_days_and_span(grid: DataFrame) -> DataFrame:
    return grid.groupBy("product_id").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        count_true(F.col("units") > 0).alias("positive_sales_days"),
    )
