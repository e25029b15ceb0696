from dataclasses import replace
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from series import day_list
from shelfcast.operators import cohort
from shelfcast.schemas import CohortRules, Protocol

START, END, CUTOFF = date(2009, 12, 1), date(2011, 12, 8), date(2011, 1, 1)


@pytest.fixture(scope="module")
def sales(spark):
    data = [(p, d, u, "thing " + p) for d in day_list(START, END) for p, u in (("a", 1.0), ("b", 2.0))]
    data.append(("late", date(2010, 12, 1), 500.0, None))
    return spark.createDataFrame(data, "product_id string, date date, units double, description string")


@pytest.fixture(scope="module")
def bounds(spark):
    return spark.createDataFrame([(START, END)], "start date, end date")


def chosen(sales, bounds, rules, cutoff=CUTOFF):
    return cohort.selected_products(cohort.cohort_eligibility(sales, bounds, cutoff, rules), rules)


def test_selection_never_looks_past_the_cutoff(sales, bounds, rows):
    one = CohortRules(product_count=1)
    changed = sales.withColumn(
        "units", F.when((F.col("product_id") == "a") & (F.col("date") >= F.lit(CUTOFF)), 100000.0)
        .otherwise(F.col("units")))
    before, after = [rows(chosen(s, bounds, one)) for s in (sales, changed)]
    assert before == after and before[0][0] == "b"
    assert len(rows(chosen(sales, bounds, CohortRules()))) == 2


def test_eligibility_fractions_and_flags(sales, bounds):
    found = {r.product_id: r for r in cohort.cohort_eligibility(sales, bounds, CUTOFF, CohortRules()).collect()}
    assert found["a"].active_day_fraction == 1.0 and found["a"].eligible
    assert found["late"].recent_active_days == 1 and not found["late"].eligible
    assert found["late"].recent_active_day_fraction == pytest.approx(1 / 90)
    flags = cohort.select_cohort(
        cohort.cohort_eligibility(sales, bounds, CUTOFF, CohortRules(product_count=1)),
        CohortRules(product_count=1))
    assert {r.product_id: r.selected for r in flags.collect()} == {"a": False, "b": True, "late": False}


def test_metadata_uses_descriptions_before_the_cutoff(spark, sales, bounds):
    later = spark.createDataFrame([("b", date(2011, 2, 1), 1.0, "renamed")], sales.schema)
    picked = chosen(sales, bounds, CohortRules())
    named = cohort.cohort_metadata(picked, sales.unionByName(later), CUTOFF)
    assert {r.product_id: r.description for r in named.collect()} == {"a": "thing a", "b": "thing b"}


def test_nothing_eligible_and_short_history_are_errors(sales, bounds):
    impossible = CohortRules(min_active_day_fraction=1.5)
    with pytest.raises(PySparkException, match="no product passes"):
        chosen(sales, bounds, impossible).collect()
    with pytest.raises(PySparkException, match="fewer days before the cutoff"):
        chosen(sales, bounds, CohortRules(), date(2010, 6, 1)).collect()


def test_cohort_comparison(spark, rows):
    ids = [spark.createDataFrame([(i,) for i in s], "product_id string") for s in ("abc", "bcd")]
    assert rows(cohort.compare_cohorts(*ids)) == [
        ("a", "new_only"), ("b", "shared"), ("c", "shared"), ("d", "old_only")]


def test_splits_end_before_each_origin_and_within_coverage(spark, bounds):
    protocol = Protocol(forecast_starts=tuple(date(2011, m, 1) for m in (1, 3, 5, 7, 9, 11)))
    splits = cohort.rolling_origin_splits(spark, protocol, bounds).orderBy("forecast_start").collect()
    assert len(splits) == 6
    first = splits[0]
    assert (first.train_end, first.forecast_end, first.training_days) == (
        date(2010, 12, 31), date(2011, 1, 28), 396)
    short = spark.createDataFrame([(START, date(2011, 11, 15))], "start date, end date")
    with pytest.raises(PySparkException, match="lies after the covered days"):
        cohort.rolling_origin_splits(spark, protocol, short).collect()
    assert replace(protocol, horizon_days=7).horizon_end(CUTOFF) == date(2011, 1, 7)
