"""Ranks over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..session import written

def dense_rank_desc(rows: DataFrame, column: str, rank: str, key: str, ranges: int | None = None) -> DataFrame:
    """Add the dense rank of ``column``, largest first; a null has no rank.

    Rows are sorted once into ranges of (value, key), so rows that tie are dealt out like
    others, however many they are. Values are numbered inside each range and shifted by the
    numbers of the ranges before; a value that goes on over a border counts once. Only one
    row per range is gathered, and nothing is joined on the value.
    """
    part = "_part"
    order = [F.desc(column), F.col(key)]
    known = rows.filter(F.col(column).isNotNull()).repartitionByRange(*([ranges] if ranges else []), *order).withColumn(
        part, F.spark_partition_id())
    inside = Window.partitionBy(part).orderBy(F.desc(column))
    # Written: the ranges are worked out anew whenever the rows are.
    placed = written(known.withColumn("_local", F.dense_rank().over(inside)), "ranges")
    borders = placed.groupBy(F.col(part).alias("_of")).agg(
        F.max("_local").alias("n"), F.max(column).alias("first"), F.min(column).alias("last"))
    before = Window.orderBy("_of")
    goes_on = F.when(F.col("first") == F.lag("last").over(before), 1).otherwise(0)
    offsets = borders.select("_of", "n", goes_on.alias("goes_on")).select(
        "_of", (F.sum(F.col("n") - F.col("goes_on")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                - F.col("n")).alias("_above"))
    ranked = placed.join(F.broadcast(offsets), F.col(part) == F.col("_of")).select(
        *rows.columns, (F.col("_local") + F.col("_above")).cast("long").alias(rank))
    return ranked.unionByName(rows.filter(F.col(column).isNull()).withColumn(rank, F.lit(None).cast("long")))


def product_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id").agg(
        F.sum("units").alias("positive_units"),
        F.sum("positive_sales_gbp").alias("positive_sales_gbp"),
        F.sum("transaction_lines").alias("retained_lines"),
        F.count(F.lit(1)).alias("active_calendar_days"),
    )


def product_rankings(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Totals per product with dense ranks by units and value, and value share."""
    totals = product_totals(sales)
    # The totals feed two sorts, each with its sample, and the grand total, so they are
    # written once instead of scanning the fact five times.
    described = written(totals.join(products, "product_id"), "product-totals")
    ranked = dense_rank_desc(described, "positive_units", "units_rank", "product_id")
    ranked = dense_rank_desc(ranked, "positive_sales_gbp", "value_rank", "product_id")
    whole = described.agg(F.sum("positive_sales_gbp").alias("v")).select(F.col("v").cast("double"))
    return ranked.withColumn(
        "value_share_pct",
        percent(F.col("positive_sales_gbp").cast("double"), whole.scalar()),
    ).select(
        "product_id", "positive_units", "positive_sales_gbp", "retained_lines",
        "active_calendar_days", "description", "units_rank", "value_rank", "value_share_pct",
    )


def in_rank_order(rankings: DataFrame) -> DataFrame:
    return rankings.orderBy("units_rank", "product_id")


def top_n_by_metric(rankings: DataFrame, metric: str, n: int = 8) -> DataFrame:
    return rankings.orderBy(F.desc(metric), "product_id").limit(n)
