"""Exponential smoothing of daily series as column expressions.

The state after a day is a level, a damped trend and one season for each weekday, the next
day's season first. A history is folded into its state for every set of coefficients of a
fixed grid; the set with the least squared error wins, and equal ones go by their coefficients.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON = 7
LEVELS = (0.05, 0.1, 0.2, 0.4, 0.7)
SEASONS = (0.02, 0.05, 0.1, 0.2, 0.4)
TRENDS = (0.05, 0.2)
DAMPINGS = (0.8, 0.95)
# Coefficient grids of the forms: level, trend, season gain and damping; a zero switches a part off.
FORMS: dict[str, list[tuple[float, float, float, float]]] = {
    "hw_weekly": list(product(LEVELS, (0.0,), SEASONS, (0.0,))),
    "ses": list(product(LEVELS, (0.0,), (0.0,), (0.0,))),
    "hw_damped_weekly": list(product(LEVELS, TRENDS, SEASONS, DAMPINGS)),
}
GAINS = ("level_gain", "trend_gain", "seasonal_gain", "damping")
TOO_SHORT = "the history is shorter than two weeks"
NOT_FINITE = "the history holds a value that is not a finite number"
AT_END = "the level gain is the greatest that was tried"


def history_fault(history: Column) -> Column:
    """Why a history cannot be fitted, or null."""
    odd = F.exists(history, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    return F.when(F.size(history) < 2 * SEASON, TOO_SHORT).when(odd, NOT_FINITE)


def _start(history: Column, seasonal: bool) -> dict[str, Column]:
    """Level: the mean of the first two weeks; seasons: the weekdays' means off it."""
    first = F.slice(history, 1, 2 * SEASON)
    level = F.aggregate(first, F.lit(0.0), lambda s, y: s + y) / float(2 * SEASON)
    seasons = [((F.get(history, F.lit(k)) + F.get(history, F.lit(k + SEASON))) / 2.0 - level) if seasonal else F.lit(0.0)
               for k in range(SEASON)]
    return {"level": level, "trend": F.lit(0.0), **{f"s{k}": s for k, s in enumerate(seasons)}, "sse": F.lit(0.0)}


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(n) for n, v in values.items()])


def folded(history: Column, gains: Column, start: Column) -> Column:
    """The state and squared error after a history, under one set of coefficients."""
    a, b, g, damping = (gains[n] for n in GAINS)

    def day(s: Column, y: Column) -> Column:
        base = s["level"] + damping * s["trend"]
        error = y - base - s["s0"]
        level = a * (y - s["s0"]) + (1.0 - a) * base
        seasons = {f"s{k}": s[f"s{k + 1}"] for k in range(SEASON - 1)}
        return _struct({
            "level": level, "trend": b * (level - s["level"]) + (1.0 - b) * damping * s["trend"], **seasons,
            f"s{SEASON - 1}": g * (y - base) + (1.0 - g) * s["s0"], "sse": s["sse"] + error * error})

    return F.aggregate(history, start, day)


def best_fit(history: Column, form: str) -> Column:
    """The state of least squared error with its coefficients; equal errors go by these.

    ``history`` is a column that stands for an array of finite numbers of two weeks at least.
    """
    grid = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(GAINS, gains)]) for gains in FORMS[form]])
    seasonal = any(gains[2] for gains in FORMS[form])

    def tried(start: Column) -> Column:
        def one(gains: Column) -> Column:
            return F.transform(F.array(folded(history, gains, start)), lambda s: F.struct(
                F.round(s["sse"], 6).alias("sse"), gains.alias("gains"), s.alias("state")))[0]
        return F.array_min(F.transform(grid, one))

    # The start is worked out once for all coefficients.
    return F.transform(F.array(_struct(_start(history, seasonal))), tried)[0]


def forecasts(fit: Column, horizon: int) -> Column:
    """The days after a history: level, damped trend and the weekday's season."""
    state, damping = fit["state"], fit["gains"]["damping"]
    days = []
    for h in range(horizon):
        grown = F.when(damping > 0, damping * (1.0 - F.pow(damping, F.lit(h + 1.0))) / (1.0 - damping)).otherwise(0.0)
        days.append(state["level"] + grown * state["trend"] + state[f"s{h % SEASON}"])
    return F.array(*days)
