import os
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import facts, reports

# A folder with previously saved calendar, totals and report tables, if there is one.
SAVED = os.environ.get("SHELFCAST_SAVED_SALES", "")
with_saved = pytest.mark.skipif(not os.path.isdir(SAVED), reason="SHELFCAST_SAVED_SALES is not set")


def synthetic(spark):
    start, end = date(2010, 1, 1), date(2011, 12, 8)
    days = facts.calendar(spark.createDataFrame([(start, end)], "start date, end date"))
    totals = days.select(
        "date", F.when(F.weekday("date") == 5, 0.0).otherwise(1.0).alias("units"),
        F.when(F.year("date") == 2010, 10).otherwise(20).cast("decimal(38,4)").alias("positive_sales_gbp"))
    return days, totals


def test_synthetic_calendar(spark):
    days, totals = synthetic(spark)
    weekdays = reports.weekday_seasonality(days, totals).collect()
    assert [w.weekday for w in weekdays][5] == "Saturday" and weekdays[5].average_daily_units == 0
    assert sum(w.covered_calendar_days for w in weekdays) == (date(2011, 12, 8) - date(2010, 1, 1)).days + 1
    months = reports.monthly_trends(days, totals).collect()
    assert not months[-1].complete_month and months[-1].comparable_monthly_growth_pct is None
    assert months[0].comparable_monthly_growth_pct is None
    years = reports.comparable_growth(days, totals).collect()
    assert years[-1].value_growth_pct == 100 and years[0].value_growth_pct is None
    labels = {r.coverage for r in reports.coverage_label(reports.monthly_trends(days, totals)).collect()}
    assert labels == {"Complete month", "Partial month"}


def test_growth_needs_adjacent_complete_periods_and_a_positive_base(spark):
    days, totals = synthetic(spark)
    gap = days.filter(~F.col("month_start").isin(date(2010, 3, 1)))
    months = {m.month_start: m for m in reports.monthly_trends(gap, totals).collect()}
    assert months[date(2010, 4, 1)].comparable_monthly_growth_pct is None
    assert months[date(2010, 5, 1)].comparable_monthly_growth_pct is not None
    nothing = totals.withColumn("positive_sales_gbp", F.lit(0).cast("decimal(38,4)"))
    assert all(y.value_growth_pct is None for y in reports.comparable_growth(days, nothing).collect())


@pytest.fixture
def saved(spark):
    def read(name):
        return pd.read_csv(f"{SAVED}/{name}.csv")
    calendar, totals = read("calendar"), read("daily_totals")
    days = spark.createDataFrame(calendar).select(
        F.to_date("date").alias("date"), F.to_date("month_start").alias("month_start"),
        F.col("weekday_number").cast("int").alias("weekday_number"), "weekday", "complete_month")
    sums = spark.createDataFrame(totals).select(
        F.to_date("date").alias("date"), "units",
        F.col("positive_sales_gbp").cast("decimal(38,4)").alias("positive_sales_gbp"))
    return days, sums, read


@with_saved
@pytest.mark.parametrize("name", ["monthly_trends", "weekday_seasonality", "comparable_growth"])
def test_saved_reports_are_reproduced(saved, name):
    days, totals, read = saved
    got = getattr(reports, name)(days, totals).toPandas()
    want = read(name)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for column in want:
        if pd.api.types.is_float_dtype(want[column]):
            pd.testing.assert_series_equal(
                got[column].astype(float), want[column], rtol=1e-10, atol=1e-6, check_names=False)


def test_sql_files_become_saved_tables(spark, rows, tmp_path):
    (tmp_path / "total.sql").write_text("SELECT SUM(units) AS u FROM facts_for_report WHERE units > :least")
    (tmp_path / "ids.sql").write_text("SELECT product_id FROM facts_for_report\nWHERE units > 1")
    (tmp_path / "notes.txt").write_text("no report")
    texts = reports.sql_files(spark, str(tmp_path))
    assert sorted(texts) == ["ids", "total"]
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "product_id string, units double")

    def run(texts, **args):
        return reports.run_sql_reports(spark, {"facts_for_report": frame}, texts, "report_tests", args)

    found = run(texts | {"old_scenario": "SELECT 1 AS x"}, least=0)
    assert rows(found["total"]) == [(3.0,)] and rows(found["ids"]) == [("b",)]
    assert spark.catalog.tableExists("report_tests.old_scenario")
    found = run(texts, least=1)
    assert rows(found["total"]) == [(2.0,)] and rows(spark.table("report_tests.total")) == [(2.0,)]
    assert not spark.catalog.tableExists("report_tests.old_scenario")
    assert not spark.catalog.tableExists("facts_for_report")
