"""Calendar-level reports and SQL text over named tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..session import fresh_path


def _growth(now: Column, before: Column) -> Column:
    """Percentage change; the difference is exact before it becomes a ratio."""
    return percent((now - before).cast("double"), before.cast("double"))


def _covered(days: DataFrame, totals: DataFrame) -> DataFrame:
    """Calendar attributes with totals; both sides hold one row per date."""
    return days.join(F.broadcast(totals.select("date", "units", "positive_sales_gbp")), "date")


def monthly_trends(days: DataFrame, totals: DataFrame) -> DataFrame:
    """Month totals and growth between adjacent complete months.

    After the aggregation there is one row per month, so the lag window is small.
    """
    months = _covered(days, totals).groupBy("month_start").agg(
        F.count(F.lit(1)).alias("covered_calendar_days"),
        F.bool_and("complete_month").alias("complete_month"),
        F.sum("units").alias("positive_units"),
        F.sum("positive_sales_gbp").alias("positive_sales_gbp"),
    )
    by_month = Window.orderBy("month_start")
    lagged = months.withColumns({
        "previous_month": F.lag("month_start").over(by_month),
        "previous_complete": F.lag("complete_month").over(by_month),
        "previous_value": F.lag("positive_sales_gbp").over(by_month),
    })
    comparable = (
        F.col("complete_month") & F.col("previous_complete")
        & (F.add_months("previous_month", 1) == F.col("month_start"))
    )
    growth = _growth(F.col("positive_sales_gbp"), F.col("previous_value"))
    return lagged.withColumn(
        "comparable_monthly_growth_pct", F.when(comparable, growth)).orderBy("month_start")


def weekday_seasonality(days: DataFrame, totals: DataFrame) -> DataFrame:
    """Sums and averages per weekday over all covered days, zero-sale days included."""
    return (
        _covered(days, totals).groupBy("weekday_number", "weekday")
        .agg(
            F.count(F.lit(1)).alias("covered_calendar_days"),
            F.sum("units").alias("positive_units"),
            F.avg("units").alias("average_daily_units"),
            F.sum("positive_sales_gbp").alias("positive_sales_gbp"),
            (F.sum("positive_sales_gbp").cast("double") / F.count(F.lit(1)))
            .alias("average_daily_sales_gbp"),
        )
        .orderBy("weekday_number")
    )


def comparable_growth(days: DataFrame, totals: DataFrame, last_month: int = 11) -> DataFrame:
    """January to November per year, for years whose months are all complete."""
    years = (
        _covered(days, totals).filter(F.month("date") <= last_month)
        .groupBy(F.year("date").alias("year"))
        .agg(
            F.countDistinct("month_start").alias("covered_months"),
            F.bool_and("complete_month").alias("complete_period"),
            F.sum("units").alias("positive_units"),
            F.sum("positive_sales_gbp").alias("positive_sales_gbp"),
        )
        .filter((F.col("covered_months") == last_month) & F.col("complete_period"))
    )
    by_year = Window.orderBy("year")
    lagged = years.withColumns({
        "previous_year": F.lag("year").over(by_year),
        "previous_value": F.lag("positive_sales_gbp").over(by_year),
        "previous_units": F.lag("positive_units").over(by_year),
    })
    adjacent = F.col("previous_year") + 1 == F.col("year")
    return lagged.withColumns({
        "value_growth_pct": F.when(
            adjacent, _growth(F.col("positive_sales_gbp"), F.col("previous_value"))),
        "units_growth_pct": F.when(
            adjacent, _growth(F.col("positive_units"), F.col("previous_units"))),
    }).orderBy("year")


def coverage_label(months: DataFrame) -> DataFrame:
    return months.withColumn(
        "coverage", F.when(F.col("complete_month"), "Complete month").otherwise("Partial month"))


def sql_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """The texts of a folder's ``.sql`` files by name, wherever Spark can read it."""
    rows = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)\.sql$", 1).alias("name"), "value").collect()
    return {r["name"]: r["value"] for r in sorted(rows)}


def run_sql_reports(
    spark: SparkSession, tables: Mapping[str, DataFrame], reports: Mapping[str, str], database: str,
    args: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """Run each SQL text over the named tables and save its rows as a table of ``database``.

    The tables are views of these names while the texts run, and go away again. ``args`` are
    the values of named parameters (``:name``) of all texts. Tables of the database that no
    text makes are stale and are dropped.
    """
    folder = fresh_path(spark, database)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    try:
        for name, text in reports.items():
            used = {k: v for k, v in (args or {}).items() if f":{k}" in text}
            rows = spark.sql(text, args=used)
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
            rows.write.option("path", f"{folder}/{name}").saveAsTable(f"{database}.{name}")
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    for table in spark.catalog.listTables(database):
        if table.name not in reports and not table.isTemporary:
            spark.sql(f"DROP TABLE {database}.{table.name}")
    return {name: spark.table(f"{database}.{name}") for name in reports}
