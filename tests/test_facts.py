import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from series import grid_of
from shelfcast.operators import facts, ranking

LINES = "product_id string, date date, units double, unit_price double, description string, last_position long"


def test_value_is_taken_before_aggregation_and_description_is_the_last(spark):
    day = date(2020, 1, 1)
    lines = spark.createDataFrame([
        ("a", day, 2.0, 10.0, "old", 1), ("a", day, 3.0, 20.0, "new", 5), ("a", day, 1.0, 0.1, None, 9),
    ], LINES)
    row = facts.product_day_sales(lines).first()
    assert (row.units, row.transaction_lines, row.description) == (6.0, 3, "new")
    assert row.positive_sales_gbp == Decimal("80.1000")


def test_dimension_takes_the_latest_known_description(spark, rows):
    d = date(2020, 1, 1)
    lines = spark.createDataFrame([
        ("a", d, 1.0, 1.0, "first", 1), ("a", d + timedelta(1), 1.0, 1.0, "second", 2),
        ("a", d + timedelta(2), 1.0, 1.0, None, 3), ("b", d, 1.0, 1.0, None, 4)], LINES)
    assert rows(facts.product_dimension(facts.product_day_sales(lines))) == [
        ("a", "second"), ("b", "Description unavailable")]


def bounds(spark, start, end):
    return spark.createDataFrame([(start, end)], "start date, end date")


def test_calendar_marks_partial_months(spark):
    days = facts.calendar(bounds(spark, date(2009, 12, 1), date(2011, 12, 8))).collect()
    assert len(days) == 738
    assert (days[0].weekday_number, days[0].weekday) == (1, "Tuesday")
    partial = {d.month_start for d in days if not d.complete_month}
    assert partial == {date(2011, 12, 1)}


def test_totals_and_grid_make_zeros_explicit(spark, rows):
    d = date(2020, 1, 1)
    sales = spark.createDataFrame(
        [("a", d, 2.0, Decimal("3"), 1), ("b", d + timedelta(2), 5.0, Decimal("4"), 2)],
        "product_id string, date date, units double, positive_sales_gbp decimal(38,4), transaction_lines long")
    days = facts.calendar(bounds(spark, d, d + timedelta(2)))
    assert [t[1] for t in rows(facts.daily_totals(sales, days))] == [2.0, 0.0, 5.0]
    ids = spark.createDataFrame([("a",), ("z",)], "product_id string")
    grid = facts.dense_daily_grid(sales, ids, days)
    assert rows(grid) == [("a", d + timedelta(i), v) for i, v in enumerate([2.0, 0.0, 0.0])] + [
        ("z", d + timedelta(i), 0.0) for i in range(3)]


def test_grid_of_random_gaps_equals_a_join(spark, rows):
    rng, first, last = random.Random(3), date(2020, 1, 1), date(2020, 3, 1)
    data = [(f"p{rng.randrange(9)}", first + timedelta(rng.randrange(-5, 70)), float(rng.randrange(5))) for _ in range(150)]
    sales = spark.createDataFrame(data, "product_id string, date date, units double").repartition(3)
    ids = spark.createDataFrame([(f"p{k}",) for k in range(0, 12, 2)], "product_id string")
    grid = facts.dense_daily_grid(sales, ids, facts.calendar(bounds(spark, first, last)))
    want = {(f"p{k}", first + timedelta(i)): 0.0 for k in range(0, 12, 2) for i in range((last - first).days + 1)}
    for p, d, u in data:
        if (p, d) in want:
            want[p, d] += u
    assert rows(grid) == sorted(((*k, v) for k, v in want.items()), key=repr)


def test_sales_summary_uses_trailing_weeks(spark):
    row = facts.sales_summary(grid_of(spark, [0, 9, 0, 0, 0, 0, 0, 1, 5, 0])).first()
    assert tuple(row) == ("example", 15.0, 1.5, 10.0, 3)
    span = facts.active_days_and_span(grid_of(spark, [0, 9, 0])).first()
    assert span.positive_sales_days == 1 and span.last_date == date(2009, 12, 3)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_rank_by_ranges_equals_one_window(spark, rows, buckets):
    # A third of the rows share one value; others repeat now and then.
    data = [(i, 5.0 if i % 3 == 0 else float(i * 37 % 90)) for i in range(300)] + [(999, None)]
    frame = spark.createDataFrame(data, "id long, v double")
    by_range = ranking.dense_rank_desc(frame, "v", "r", "id", buckets)
    order = sorted({v for _, v in data if v is not None}, reverse=True)
    want = sorted(((i, v, order.index(v) + 1 if v is not None else None) for i, v in data), key=repr)
    assert sorted(((r.id, r.v, r.r) for r in by_range.collect()), key=repr) == want


def test_rankings_share_and_order(spark):
    d = date(2020, 1, 1)
    data = [(f"p{i}", d + timedelta(j), float(i % 4 + 1), Decimal(i + 1), 1) for i in range(9) for j in range(2)]
    sales = spark.createDataFrame(
        data, "product_id string, date date, units double, positive_sales_gbp decimal(38,4), transaction_lines long")
    names = sales.select("product_id", F.lit("n").alias("description")).distinct()
    ranked = ranking.in_rank_order(ranking.product_rankings(sales, names)).collect()
    units = sorted({r.positive_units for r in ranked}, reverse=True)
    assert [r.units_rank for r in ranked] == [units.index(r.positive_units) + 1 for r in ranked]
    assert [r.units_rank for r in ranked] == sorted(r.units_rank for r in ranked)
    assert sum(r.value_share_pct for r in ranked) == pytest.approx(100)
    assert [r.product_id for r in ranked][:2] == ["p3", "p7"] and ranked[0].active_calendar_days == 2
    top = ranking.top_n_by_metric(ranking.product_rankings(sales, names), "positive_sales_gbp", 2)
    assert {r.product_id for r in top.collect()} == {"p8", "p7"}
