"""Error scores and method comparisons.

Ratios are always taken after summing, at whatever level is asked for; averages of
ratios appear only where the name says so (``mean_product_wape``). An undefined
ratio is null and stays null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_true, finite_or_fail, percent, relative_reduction


def score_aggregates() -> list[Column]:
    """The nine score fields over columns ``actual`` and ``prediction``."""
    message = "every scored day needs a finite actual and prediction"
    actual = finite_or_fail(F.col("actual"), message)
    signed = finite_or_fail(F.col("prediction"), message) - actual
    absolute, whole = F.sum(F.abs(signed)), F.sum(F.abs(actual))
    zero = F.lit(0.0)
    return [
        F.avg(F.abs(signed)).alias("mae"),
        percent(absolute, whole).alias("wape"),
        F.avg(signed).alias("signed_bias"),
        percent(F.sum(signed), whole).alias("percentage_bias"),
        F.sum(F.greatest(signed, zero)).alias("overprediction_units"),
        F.sum(F.greatest(-signed, zero)).alias("underprediction_units"),
        absolute.alias("absolute_error_sum"),
        whole.alias("actual_units"),
        F.count(F.lit(1)).alias("observations"),
    ]


def scores(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(*score_aggregates())


def product_summaries(predictions: DataFrame, *period: str) -> DataFrame:
    """Scores per (method, product), pooled over periods unless one is named."""
    return scores(predictions, *period, "model", "product_id")


def pooled(products: DataFrame, *period: str) -> DataFrame:
    """Scores per method from product scores, with the mean of defined product ratios.

    Sums and counts add up exactly, so predictions are aggregated once, at product
    level, and this second step reads one row per (method, product).
    """
    n, whole = F.sum("observations"), F.sum("actual_units")
    signed = F.sum("overprediction_units") - F.sum("underprediction_units")
    absolute = F.sum("absolute_error_sum")
    return products.groupBy(*period, "model").agg(
        (absolute / n).alias("mae"),
        percent(absolute, whole).alias("wape"),
        (signed / n).alias("signed_bias"),
        percent(signed, whole).alias("percentage_bias"),
        F.sum("overprediction_units").alias("overprediction_units"),
        F.sum("underprediction_units").alias("underprediction_units"),
        absolute.alias("absolute_error_sum"),
        whole.alias("actual_units"),
        n.alias("observations"),
        F.avg("wape").alias("mean_product_wape"),
    )


def overall_summaries(predictions: DataFrame, *period: str) -> DataFrame:
    return pooled(product_summaries(predictions, *period), *period)


# --- comparisons ------------------------------------------------------------------


def product_outcome(actual: Column, difference: Column, tolerance: float) -> Column:
    """Win, loss or tie by summed absolute error; undefined without actual units."""
    return (
        F.when(actual == 0, "undefined")
        .when(F.abs(difference) <= tolerance, "tie")
        .when(difference > 0, "win")
        .otherwise("loss")
    )


def pair_list(candidates: Iterable[str], baselines: Iterable[str]) -> list[tuple[str, str]]:
    others = list(baselines)
    return [(c, b) for c in candidates for b in others if c != b]


def product_comparisons(
    products: DataFrame, pairs: list[tuple[str, str]], tolerance: float, *period: str,
) -> DataFrame:
    """Each candidate against each of its baselines, per product.

    A product's scores under all methods meet in one group (as many entries as there
    are methods) and the listed pairs are read from it: one shuffle, no self join.
    A method missing for any product stops the run, since the populations differ.
    """
    fields = F.struct("wape", "absolute_error_sum", "actual_units", "signed_bias")
    by_method = products.groupBy(*period, "product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", fields))).alias("m"))
    listed = F.array(*[
        F.struct(F.lit(c).alias("model"), F.lit(b).alias("baseline")) for c, b in pairs])
    paired = by_method.select(*period, "product_id", "m", F.inline(listed))
    missing = F.raise_error(F.lit("a method has no scores for a product that others have"))
    kind = by_method.schema["m"].dataType.valueType

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at("m", F.col(name)), missing.cast(kind))

    both = paired.withColumns({"c": of("model"), "b": of("baseline")})
    difference = F.col("b.absolute_error_sum") - F.col("c.absolute_error_sum")
    return both.select(
        *period, "model", "baseline", "product_id",
        product_outcome(F.col("c.actual_units"), difference, tolerance).alias("outcome"),
        F.col("c.wape").alias("model_wape"),
        F.col("b.wape").alias("baseline_wape"),
        difference.alias("error_reduction_units"),
        relative_reduction(F.col("b.wape"), F.col("c.wape")).alias("relative_wape_reduction_pct"),
        F.col("c.actual_units").alias("actual_units"),
        F.col("c.absolute_error_sum").alias("absolute_error_sum"),
        F.col("b.absolute_error_sum").alias("baseline_absolute_error"),
        F.col("c.signed_bias").alias("signed_bias"),
    )


COMPARISON_DETAIL = [
    "model", "baseline", "product_id", "outcome", "model_wape", "baseline_wape",
    "error_reduction_units", "relative_wape_reduction_pct",
]


def comparison_summary(detail: DataFrame, *period: str) -> DataFrame:
    """Pooled ratios and win counts per (candidate, baseline)."""
    whole = F.sum("actual_units")
    model, base = F.sum("absolute_error_sum"), F.sum("baseline_absolute_error")
    counted = detail.groupBy(*period, "model", "baseline").agg(
        percent(model, whole).alias("model_wape"),
        percent(base, whole).alias("baseline_wape"),
        (base - model).alias("error_reduction_units"),
        *[count_true(F.col("outcome") == kind).alias(name) for kind, name in [
            ("win", "wins"), ("loss", "losses"), ("tie", "ties"), ("undefined", "undefined")]],
    )
    comparable = F.col("wins") + F.col("losses") + F.col("ties")
    return counted.withColumns({
        "relative_wape_reduction_pct": relative_reduction(F.col("baseline_wape"), F.col("model_wape")),
        "comparable_products": comparable,
        "win_pct": percent(F.col("wins").cast("double"), comparable.cast("double")),
    }).select(
        *period, "model", "baseline", "model_wape", "baseline_wape", "relative_wape_reduction_pct",
        "error_reduction_units", "wins", "losses", "ties", "undefined", "comparable_products",
        "win_pct",
    )


def period_win_count(period_comparisons: DataFrame) -> DataFrame:
    return period_comparisons.groupBy("model", "baseline").agg(
        count_true(F.col("relative_wape_reduction_pct") > 0).alias("periods_won"),
        F.count(F.lit(1)).alias("periods"),
    )


# --- selections ---------------------------------------------------------------------


def method_ranking(overall: DataFrame) -> DataFrame:
    """Methods from lowest to highest pooled ratio; undefined ratios come last."""
    return overall.select("model", "wape").orderBy(F.asc_nulls_last("wape"), "model")


def best_methods(overall: DataFrame, smoothing: Iterable[str]) -> DataFrame:
    """Best method overall, best smoothing history and strongest baseline, in one pass."""
    smooth = F.col("model").isin(*smoothing)
    defined = F.col("wape").isNotNull()

    def best(where: Column) -> Column:
        return F.min(F.when(where & defined, F.struct("wape", "model")))["model"]

    return overall.agg(
        best(F.lit(True)).alias("best_method"),
        best(smooth).alias("best_smoothing"),
        best(~smooth).alias("strongest_baseline"),
    )


def validation_selection(predictions: DataFrame, stage: str = "validation") -> DataFrame:
    """The method with the lowest pooled ratio over the validation origins."""
    pooled_scores = scores(predictions.filter(F.col("stage") == stage), "model")
    # A method without a defined ratio cannot be chosen.
    return pooled_scores.filter(F.col("wape").isNotNull()).agg(F.min(F.struct("wape", "model")).alias("b")).select(
        F.col("b.model").alias("selected_model"), F.col("b.wape").alias("validation_wape"))


def forecast_performance(predictions: DataFrame) -> DataFrame:
    return scores(predictions, "stage", "model").select(
        "stage", "model", "observations", "mae", F.col("wape").alias("pooled_wape"))


def beat_baseline_share(detail: DataFrame) -> DataFrame:
    """Products beating the fixed baseline, as count and share of the comparable ones."""
    summary = comparison_summary(detail)
    return summary.select(
        "model", F.col("wins").alias("products_beating_baseline"), "comparable_products",
        F.col("win_pct").alias("products_beating_baseline_pct"))


def relabel(frame: DataFrame, labels: dict[str, str], column: str = "model") -> DataFrame:
    """Join display names from a constant table; unknown codes get a null name."""
    rows = [F.struct(F.lit(k).alias(column), F.lit(v).alias("method")) for k, v in labels.items()]
    names = frame.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return frame.join(F.broadcast(names), column, "left")


