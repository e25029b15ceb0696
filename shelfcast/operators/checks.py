"""Structural checks and table reconciliation.

Checks return a table of violations; ``require_none`` stops the run when it has rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import Protocol

# Reconciliation tolerances and the columns compared exactly.
RTOL, ATOL, MONEY_ATOL = 1e-10, 1e-8, 1e-6
EXACT = {
    "horizon_day", "observations", "training_days", "training_observations", "wins", "losses",
    "ties", "undefined", "negative_predictions_clipped", "covered_calendar_days",
}
VIOLATION = ["check", "product_id", "forecast_start", "rows"]


def require_none(violations: DataFrame) -> None:
    """Stop on the first violation; only a few rows ever reach the driver."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"Structural checks failed: {[r.asDict() for r in found]}")


def invalid_units(units: Column) -> Column:
    """Neither null nor negative nor anything but a finite number may stand for an amount."""
    return units.isNull() | F.isnan(units) | (F.abs(units) == F.lit(float("inf"))) | (units < 0)


def grid_preflight(grid: DataFrame, products: DataFrame, protocol: Protocol) -> DataFrame:
    """Everything that would make a backtest on this grid invalid.

    One grouping by (product, date) finds repeats, a second by product counts, for
    every origin at once, the days inside its span. Population differences come from
    one full join of ids.
    """
    first = protocol.expanding_start
    for start in protocol.forecast_starts:
        if (start - first).days < protocol.min_history_days:
            raise ValueError(f"{start} has fewer days before it than the protocol asks for")
    per_day = grid.groupBy("product_id", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(invalid_units(F.col("units"))).alias("bad"),
    )
    spans = [
        F.count_if(F.col("date").between(F.lit(first), F.lit(protocol.horizon_end(s)))).alias(f"d{i}")
        for i, s in enumerate(protocol.forecast_starts)
    ]
    per_product = per_day.groupBy("product_id").agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeats"),
        F.sum("bad").alias("bad"), *spans,
    )
    listed = products.select("product_id").withColumn("listed", F.lit(True))
    both = per_product.join(listed, "product_id", "full")
    gaps = []
    for i, start in enumerate(protocol.forecast_starts):
        days = (protocol.horizon_end(start) - first).days + 1
        gaps.append(F.struct(F.lit(start).alias("start"), (F.lit(days) - F.col(f"d{i}")).alias("gap")))
    # Each product carries its own list of problems; rows without any disappear.
    def problem(name: str, rows: Column, start: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            (F.lit(None).cast("date") if start is None else start).alias("forecast_start"),
            rows.cast("long").alias("rows"))
    found = F.concat(
        F.array(
            problem("duplicate_product_day", F.col("repeats")),
            problem("invalid_units", F.col("bad")),
            problem("changed_population",
                    F.when(F.col("listed").isNull() | F.col("repeats").isNull(), 1).otherwise(0)),
        ),
        F.transform(F.array(*gaps), lambda g: problem("incomplete_calendar", g["gap"], g["start"])),
    )
    return both.select("product_id", F.inline(found)).filter(F.col("rows") > 0).select(*VIOLATION)


def support_validation(
    predictions: DataFrame, products: DataFrame, methods: list[str], protocol: Protocol,
) -> DataFrame:
    """Unique keys, full method coverage, identical support, whole consecutive horizons."""
    horizon = protocol.horizon_days
    fields = [c for c in ("actual", "spike_threshold", "is_spike") if c in predictions.columns]
    per_day = predictions.groupBy("product_id", "forecast_start", "date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("model").alias("models"),
        F.count_if(~F.col("model").isin(*methods)).alias("unknown"),
        F.min(F.struct(*fields)).alias("lo"), F.max(F.struct(*fields)).alias("hi"),
        F.count_if(F.datediff("date", "forecast_start") + 1 != F.col("horizon_day")).alias("shifted"),
    )
    per_origin = per_day.groupBy("product_id", "forecast_start").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.when(F.col("rows") > F.col("models"), 1).otherwise(0)).alias("duplicate_key"),
        F.sum(F.when((F.col("models") != len(methods)) | (F.col("unknown") > 0), 1).otherwise(0))
        .alias("method_coverage"),
        F.sum(F.when(~F.col("lo").eqNullSafe(F.col("hi")), 1).otherwise(0)).alias("support_differs"),
        F.sum("shifted").alias("not_consecutive"),
    )
    starts = F.array(*[F.lit(s) for s in protocol.forecast_starts])
    expected = products.select("product_id", F.explode(starts).alias("forecast_start"))
    both = expected.join(per_origin, ["product_id", "forecast_start"], "full")
    names = ["duplicate_key", "method_coverage", "support_differs", "not_consecutive"]
    checks = [F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("rows")) for n in names]
    short = F.abs(F.lit(horizon) - F.coalesce("days", F.lit(0))).cast("long")
    checks.append(F.struct(F.lit("horizon_coverage").alias("check"), short.alias("rows")))
    return (
        both.select("product_id", "forecast_start", F.inline(F.array(*checks)))
        .filter(F.col("rows") > 0).select(*VIOLATION)
    )


# --- reconciliation -------------------------------------------------------------------


# Columns whose subsets are tried as keys: 2^6 - 1 groupings of one pass.
MOST_KEY_COLUMNS = 6


def unique_key(left: DataFrame, right: DataFrame, among: list[str] | None = None) -> list[str]:
    """The smallest set of columns that tells the rows of both tables apart.

    All sets of ``among`` are grouped in one pass; of equally small ones that with the
    earliest columns is taken. Without ``among`` the text, date and flag columns stand for it:
    the first ``MOST_KEY_COLUMNS`` of them. One row per set comes to the driver.
    """
    if among is None:
        kinds = (T.StringType, T.DateType, T.BooleanType, T.TimestampType, T.TimestampNTZType)
        among = [f.name for f in left.schema if isinstance(f.dataType, kinds)][:MOST_KEY_COLUMNS]
    if not 0 < len(among) <= MOST_KEY_COLUMNS:
        raise ValueError(f"between one and {MOST_KEY_COLUMNS} columns can be tried as keys")
    keys = [c for n in range(1, len(among) + 1) for c in combinations(among, n)]
    # The id of a grouping has a bit for each column that is left out, the last column lowest.
    number = {sum(1 << (len(among) - 1 - i) for i, c in enumerate(among) if c not in key): key for key in keys}
    side = F.lit(0).alias("_side")
    both = left.select(*among, side).unionByName(right.select(*among, F.lit(1).alias("_side")))
    counted = both.groupingSets([[F.col("_side"), *map(F.col, key)] for key in keys], "_side", *among).agg(
        F.grouping_id("_side", *among).alias("_id"), F.count(F.lit(1)).alias("_n"))
    repeated = {r["_id"] for r in counted.filter("_n > 1").select("_id").distinct().collect()}
    for id_, key in sorted(number.items(), key=lambda x: (len(x[1]), [among.index(c) for c in x[1]])):
        if id_ not in repeated:
            return list(key)
    raise ValueError("no set of the columns tells the rows of both sides apart")


def _differs(name: str, kind: T.DataType, left: Column, right: Column) -> Column:
    numeric = isinstance(kind, T.NumericType) and name not in EXACT
    if not numeric:
        return ~left.eqNullSafe(right)
    atol = MONEY_ATOL if "gbp" in name or "value" in name else ATOL
    a, b = left.cast("double"), right.cast("double")
    close = F.abs(a - b) <= F.lit(atol) + F.lit(RTOL) * F.abs(b)
    return ~F.coalesce(close | a.eqNullSafe(b), F.lit(False))


def table_reconcile(left: DataFrame, right: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows that differ, per column, plus rows present on one side only.

    Equal tables give zero in every row. Keys, counts, flags and text must be equal;
    other numbers may differ within the tolerances; null equals null.
    """
    if list(left.columns) != list(right.columns):
        raise ValueError(f"Schema differs: {left.columns} and {right.columns}")
    key = key or unique_key(left, right)
    values = [c for c in left.columns if c not in key]
    l = left.select(*key, F.struct(*values, F.lit(1).alias("_in")).alias("l"))
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(key)],
                     F.struct(*values, F.lit(1).alias("_in")).alias("r"))
    same = reduce(lambda a, b: a & b, [l[k].eqNullSafe(r[f"_r{i}"]) for i, k in enumerate(key)])
    both = l.join(r, same, "full")
    matched = F.col("l").isNotNull() & F.col("r").isNotNull()
    counts = [F.count_if(F.col("r").isNull()).alias("only_left"),
              F.count_if(F.col("l").isNull()).alias("only_right")]
    counts += [
        F.count_if(matched & _differs(f.name, f.dataType, F.col(f"l.`{f.name}`"), F.col(f"r.`{f.name}`")))
        .alias(f.name)
        for f in left.schema if f.name not in key
    ]
    row = both.agg(*counts)
    pairs = [F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("differences")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def metric_reconcile(
    recomputed: DataFrame, stored: DataFrame, rename: dict[str, str], key: list[str] | None = None,
) -> DataFrame:
    """Reconcile after renaming methods that changed their name between the two runs."""
    name = F.col("model")
    for new, old in rename.items():
        name = F.when(F.col("model") == new, F.lit(old)).otherwise(name)
    return table_reconcile(recomputed.withColumn("model", name), stored, key)


PREDICTION_KEY = ["model", "product_id", "forecast_start", "date"]
PREDICTION_FIELDS = [
    "horizon_day", "actual", "prediction", "status", "training_observations", "spike_threshold", "is_spike"]


def prediction_reconcile(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Predictions against saved ones: keys, statuses, labels and day numbers exactly, the
    numbers within the tolerances."""
    columns = PREDICTION_KEY + PREDICTION_FIELDS
    return table_reconcile(recomputed.select(*columns), stored.select(*columns), PREDICTION_KEY)
