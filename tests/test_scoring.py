from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfcast.operators import diagnostics, scoring

SCHEMA = "model string, product_id string, actual double, prediction double"


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def test_score_fields(spark):
    row = scoring.scores(frame(spark, [("m", "p", 10.0, 8.0), ("m", "p", 0.0, 4.0), ("m", "p", 20.0, 24.0)])).first()
    assert row.mae == pytest.approx(10 / 3) and row.wape == pytest.approx(100 / 3)
    assert (row.signed_bias, row.overprediction_units, row.underprediction_units) == (2.0, 8.0, 2.0)
    assert row.percentage_bias == pytest.approx(20) and row.observations == 3
    assert row.overprediction_units + row.underprediction_units == row.absolute_error_sum


def test_undefined_ratios_are_null_and_nonfinite_values_fail(spark):
    row = scoring.scores(frame(spark, [("m", "p", 0.0, 1.0), ("m", "p", 0.0, 1.0)])).first()
    assert row.wape is None and row.percentage_bias is None and row.mae == 1.0
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(PySparkException, match="finite"):
            scoring.scores(frame(spark, [("m", "p", 1.0, bad)])).collect()


def test_pooled_ratio_is_not_the_mean_of_ratios(spark):
    data = [("m", "a", 100.0, 90.0), ("m", "a", 1.0, 0.0), ("m", "b", 10.0, 10.0), ("m", "b", 0.0, 5.0)]
    row = scoring.overall_summaries(frame(spark, data)).first()
    assert row.wape == pytest.approx(1600 / 111)
    assert row.mean_product_wape == pytest.approx((1100 / 101 + 50) / 2)
    direct = scoring.scores(frame(spark, data), "model").first()
    for field in ("mae", "wape", "signed_bias", "percentage_bias", "absolute_error_sum", "observations"):
        assert row[field] == pytest.approx(direct[field])


ERRORS = {"win": (10.0, 10.0), "loss": (10.0, 12.0), "tie": (10.0, 10.0), "zero": (0.0, 1.0)}
BASES = ["x", "y", "z"]


def outcome_frame(spark):
    base = {"win": 12.0, "loss": 10.0, "tie": 10.0, "zero": 0.0}
    data = [("cand", p, a, v) for p, (a, v) in ERRORS.items()]
    data += [(b, p, ERRORS[p][0], v) for b in BASES for p, v in base.items()]
    return frame(spark, data)


def test_outcomes_against_three_baselines(spark):
    products = scoring.product_summaries(outcome_frame(spark))
    detail = scoring.product_comparisons(products, scoring.pair_list(["cand"], BASES), 1e-9)
    assert detail.count() == 12
    for row in scoring.comparison_summary(detail).collect():
        assert (row.wins, row.losses, row.ties, row.undefined) == (1, 1, 1, 1)
        assert row.comparable_products == 3 and row.win_pct == pytest.approx(100 / 3)
    share = scoring.beat_baseline_share(detail).first()
    assert share.products_beating_baseline == 1
    contributions = diagnostics.product_contributions(
        detail, products.select("product_id", F.lit("d").alias("description")).distinct())
    sums = contributions.groupBy("baseline").agg(
        F.sum("share_of_actual_units_pct").alias("u"), F.sum("share_of_model_error_pct").alias("e"))
    assert all(r.u == pytest.approx(100) and r.e == pytest.approx(100) for r in sums.collect())


def test_different_populations_stop_the_comparison(spark):
    products = scoring.product_summaries(outcome_frame(spark)).filter(
        ~((F.col("model") == "y") & (F.col("product_id") == "tie")))
    with pytest.raises(PySparkException, match="no scores for a product"):
        scoring.product_comparisons(products, [("cand", "y")], 1e-9).collect()


def test_reduction_needs_a_positive_base(spark):
    from shelfcast.functions.numbers import relative_reduction

    data = frame(spark, [(50.0, 60.0), (0.0, 0.0), (None, 1.0), (1.0, None)], "b double, c double")
    found = [r[0] for r in data.select(relative_reduction(F.col("b"), F.col("c"))).collect()]
    assert found == [-20.0, None, None, None]


def test_ranking_selection_and_labels(spark, rows):
    overall = frame(spark, [("hw_a", 5.0), ("base_b", 4.0), ("hw_c", 4.5), ("base_d", None)],
                    "model string, wape double")
    assert [r.model for r in scoring.method_ranking(overall).collect()] == [
        "base_b", "hw_c", "hw_a", "base_d"]
    assert tuple(scoring.best_methods(overall, ["hw_a", "hw_c"]).first()) == ("base_b", "hw_c", "base_b")
    assert rows(scoring.relabel(overall, {"hw_a": "A"}), "model", "method")[-2:] == [
        ("hw_a", "A"), ("hw_c", None)]


def test_validation_chooses_the_lowest_pooled_ratio(spark):
    data = [("validation", "a", 10.0, 12.0), ("validation", "b", 10.0, 11.0), ("test", "a", 10.0, 10.0),
            ("test", "b", 10.0, 30.0)]
    staged = frame(spark, data, "stage string, model string, actual double, prediction double")
    assert tuple(scoring.validation_selection(staged).first()) == ("b", 10.0)
    assert {(r.stage, r.model): r.mae for r in scoring.forecast_performance(staged).collect()}[("test", "b")] == 20


DAYS = ("model string, product_id string, forecast_start date, date date, actual double, "
        "prediction double, spike_threshold double, is_spike boolean, horizon_day int")


def walk_frame(spark):
    s1, s2 = date(2020, 1, 1), date(2020, 3, 1)
    data = []
    for product, start, cand, comp in [("a", s1, 1.0, 5.0), ("a", s2, 2.0, 3.0), ("b", s1, 4.0, 1.0),
                                       ("b", s2, 6.0, 1.0), ("c", s1, 1.0, 6.0), ("c", s2, 0.0, 0.0)]:
        for model, error in (("cand", cand), ("comp", comp)):
            data.append((model, product, start, start, 10.0, 10.0 + error, 8.0, product == "a", 1))
    return frame(spark, data, DAYS)


def test_walkthrough_picks_extremes_with_tie_breaks(spark):
    paired = diagnostics.paired_errors(walk_frame(spark), "cand", "comp")
    up = diagnostics.walkthrough_product(paired, True).first()
    # Products a and c gain five units each; the smaller id is shown.
    assert (up.product_id, up.error_reduction_units, up.forecast_start) == ("a", 5.0, date(2020, 1, 1))
    assert up.period_error_reduction_units == 4.0 and up.candidate_wape == 15.0
    down = diagnostics.walkthrough_product(paired, False).first()
    assert (down.product_id, down.forecast_start, down.period_error_reduction_units) == (
        "b", date(2020, 3, 1), -5.0)
    spike = diagnostics.walkthrough_spike(walk_frame(spark), "cand").first()
    assert (spike.product_id, spike.forecast_start, spike.excess_units) == ("a", date(2020, 1, 1), 2.0)
    with pytest.raises(PySparkException, match="do not share their actual"):
        short = walk_frame(spark).filter(~((F.col("model") == "comp") & (F.col("product_id") == "b")))
        diagnostics.paired_errors(short, "cand", "comp").collect()


def test_improvements_series_and_spike_shares(spark, rows):
    detail = frame(spark, [(f"p{i}", float(v)) for i, v in enumerate([3, -1, 0, 9, 9, -7])],
                   "product_id string, error_reduction_units double")
    assert [r.product_id for r in diagnostics.largest_improvements(detail, 2).collect()] == ["p3", "p4"]
    assert [r.product_id for r in diagnostics.largest_deteriorations(detail).collect()] == ["p5", "p1"]
    days = walk_frame(spark)
    assert diagnostics.long_series_union(days, "cand").count() == 6 + 12
    share = {r.model: r for r in diagnostics.spike_summary(days).collect()}["cand"]
    assert (share.spike_product_days, share.product_days, share.spike_absolute_error) == (2, 6, 3.0)
    assert share.spike_error_share_pct == pytest.approx(100 * 3 / 14)
    assert rows(diagnostics.distinct_top_products(days, "cand", 3)) == [("a",), ("b",)]
