"""Named SQL tables the checking queries are built from (DuckDB dialect).

They are written from the definitions, not from the Spark plans: copies are numbered
with window functions, histories are range joins, and so on.
"""

from __future__ import annotations

import re

from ..functions.smoothing import FORMS

_CODE = (
    "lpad(CAST(l_suppkey % 100000 AS VARCHAR), 5, '0') || CASE WHEN l_suppkey >= 100000 THEN "
    "chr(CAST(65 + ((l_suppkey // 100000 - 1) // 26) % 26 AS INTEGER)) || "
    "chr(CAST(65 + (l_suppkey // 100000 - 1) % 26 AS INTEGER)) ELSE '' END"
)
_DESCRIBED = f"CASE WHEN l_discount <> 0.07 THEN 'Item ' || {_CODE} || ' ' || l_returnflag END"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
_FIELDS = "invoice, stock_code, description, quantity, invoice_date, price, customer_id, country"

TABLES = {
    "raw": f"""
SELECT l_linestatus AS source, {_ORDER},
  CASE WHEN l_tax = 0.04 AND l_discount = 0.10 THEN '  '
       WHEN l_returnflag = 'R' AND l_tax = 0.0 THEN ' c' || CAST(l_suppkey AS VARCHAR)
       ELSE CAST(l_suppkey AS VARCHAR) END AS invoice,
  CASE WHEN l_tax = 0.07 AND l_discount = 0.10 THEN '   '
       WHEN l_tax = 0.06 AND l_discount = 0.10 THEN 'POST'
       WHEN l_tax = 0.05 AND l_discount = 0.10 THEN 'gift_0001_20'
       WHEN l_linenumber = 1 THEN chr(9) || lower({_CODE}) || ' '
       ELSE {_CODE} END AS stock_code,
  {_DESCRIBED} AS description,
  CASE WHEN l_tax = 0.08 AND l_discount = 0.09 THEN 'n/a'
       WHEN l_tax = 0.07 AND l_discount = 0.09 THEN '0'
       WHEN l_returnflag = 'R' AND l_discount = 0.09 THEN '-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
       ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity,
  CASE WHEN l_tax = 0.08 AND l_discount = 0.10 THEN 'not a date'
       ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS invoice_date,
  CASE WHEN l_tax = 0.08 AND l_discount = 0.08 THEN NULL
       WHEN l_tax = 0.07 AND l_discount = 0.08 THEN '0'
       WHEN l_tax = 0.06 AND l_discount = 0.08 THEN '-1.50'
       ELSE CAST(l_suppkey % 50 + 1 AS VARCHAR) || '.' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')
  END AS price,
  CASE WHEN l_discount <> 0.0 THEN CAST(l_suppkey AS VARCHAR) END AS customer_id,
  CASE WHEN l_linenumber > 5 THEN 'France' ELSE 'United Kingdom' END AS country
FROM lineitem""",
    "typed": r"""
SELECT *, TRY_CAST(invoice_date AS TIMESTAMP) AS sold_at,
  CAST(TRY_CAST(invoice_date AS TIMESTAMP) AS DATE) AS date,
  TRY_CAST(quantity AS DOUBLE) AS units, TRY_CAST(price AS DOUBLE) AS unit_price,
  upper(regexp_replace(stock_code, '^\s+|\s+$', '', 'g')) AS product_id,
  regexp_replace(invoice, '^\s+|\s+$', '', 'g') AS invoice_id
FROM raw""",
    "numbered": f"""
SELECT *, row_number() OVER (PARTITION BY {_FIELDS}, source ORDER BY {_ORDER}) - 1 AS occurrence
FROM typed""",
    "flagged": f"""
SELECT *, sold_at IS NULL AS invalid_date,
  product_id IS NULL OR product_id = '' OR invoice_id IS NULL OR invoice_id = '' AS missing_product_or_invoice,
  row_number() OVER (PARTITION BY {_FIELDS}, occurrence ORDER BY {_ORDER}) > 1 AS cross_sheet_replica,
  COALESCE(starts_with(upper(invoice_id), 'C'), FALSE) AS cancellation_invoice,
  COALESCE(units < 0, FALSE) AS negative_quantity,
  units IS NULL OR units = 0 AS zero_or_invalid_quantity,
  NOT COALESCE(regexp_full_match(product_id, '[0-9]{{5}}[A-Z]{{0,2}}'), FALSE) AS non_product_code,
  unit_price IS NULL OR unit_price <= 0 AS nonpositive_or_invalid_price,
  COALESCE(date = (SELECT MAX(date) FROM typed), FALSE) AS final_incomplete_day
FROM numbered""",
    "reasoned": """
SELECT *, CASE WHEN invalid_date THEN 'invalid_date'
  WHEN missing_product_or_invoice THEN 'missing_product_or_invoice'
  WHEN cross_sheet_replica THEN 'cross_sheet_replica'
  WHEN cancellation_invoice THEN 'cancellation_invoice'
  WHEN negative_quantity THEN 'negative_quantity'
  WHEN zero_or_invalid_quantity THEN 'zero_or_invalid_quantity'
  WHEN non_product_code THEN 'non_product_code'
  WHEN nonpositive_or_invalid_price THEN 'nonpositive_or_invalid_price'
  WHEN final_incomplete_day THEN 'final_incomplete_day'
  ELSE 'retained' END AS reason
FROM flagged""",
    "merchandise": "SELECT * FROM reasoned WHERE reason = 'retained'",
    "bounds": "SELECT MIN(date) AS first_day, MAX(date) - 1 AS last_day FROM typed",
    "sales": """
SELECT product_id, date, SUM(units) AS units,
  SUM(CAST(units * unit_price AS DECIMAL(18,4))) AS positive_sales_gbp, COUNT(*) AS transaction_lines,
  last(description ORDER BY l_orderkey * 8 + l_linenumber, description)
    FILTER (WHERE description IS NOT NULL) AS description
FROM merchandise GROUP BY product_id, date""",
    "line_days": """
SELECT MAX(CAST(l_shipdate AS DATE)) - 1 AS last_day FROM lineitem""",
    "brand_sales": """
SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS units
FROM lineitem JOIN part ON p_partkey = l_partkey, line_days WHERE CAST(l_shipdate AS DATE) <= last_day GROUP BY 1, 2""",
    "part_sales": """
SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_shipdate AS DATE) AS date,
  SUM(l_quantity) AS units,
  SUM(CAST(l_quantity * l_extendedprice AS DECIMAL(18,4))) AS positive_sales_gbp,
  COUNT(*) AS transaction_lines
FROM lineitem, line_days WHERE CAST(l_shipdate AS DATE) <= last_day GROUP BY 1, 2""",
    "products": """
SELECT product_id, COALESCE(last(description ORDER BY date) FILTER (WHERE description IS NOT NULL),
  'Description unavailable') AS description
FROM sales GROUP BY product_id""",
    "days": """
SELECT date, CAST(date_trunc('month', date) AS DATE) AS month_start,
  isodow(date) - 1 AS weekday_number, dayname(date) AS weekday,
  date_trunc('month', date) >= first_day AND last_day(date) <= kept AS complete_month
FROM (SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS date,
        first_day, last_day AS kept FROM bounds) AS span""",
    "totals": """
SELECT days.date, COALESCE(SUM(units), 0) AS units,
  COALESCE(SUM(positive_sales_gbp), 0) AS positive_sales_gbp,
  COALESCE(SUM(transaction_lines), 0) AS transaction_lines
FROM days LEFT JOIN sales ON sales.date = days.date GROUP BY days.date""",
    "monthly": """
SELECT month_start, COUNT(*) AS covered_calendar_days, BOOL_AND(complete_month) AS complete_month,
  SUM(units) AS positive_units, SUM(positive_sales_gbp) AS positive_sales_gbp
FROM days JOIN totals USING (date) GROUP BY month_start""",
    "monthly_trends": """
SELECT a.*, b.month_start AS previous_month, b.complete_month AS previous_complete,
  b.positive_sales_gbp AS previous_value,
  CASE WHEN a.complete_month AND b.complete_month
    THEN 100 * CAST(a.positive_sales_gbp - b.positive_sales_gbp AS DOUBLE)
      / NULLIF(CAST(b.positive_sales_gbp AS DOUBLE), 0)
  END AS comparable_monthly_growth_pct
FROM monthly a LEFT JOIN monthly b ON b.month_start + INTERVAL 1 MONTH = a.month_start""",
    "weekdays": """
SELECT weekday_number, weekday, COUNT(*) AS covered_calendar_days, SUM(units) AS positive_units,
  AVG(units) AS average_daily_units, SUM(positive_sales_gbp) AS positive_sales_gbp,
  CAST(SUM(positive_sales_gbp) AS DOUBLE) / COUNT(*) AS average_daily_sales_gbp
FROM days JOIN totals USING (date) GROUP BY weekday_number, weekday""",
    "years": """
SELECT year(date) AS year, COUNT(DISTINCT month_start) AS covered_months,
  BOOL_AND(complete_month) AS complete_period, SUM(units) AS positive_units,
  SUM(positive_sales_gbp) AS positive_sales_gbp
FROM days JOIN totals USING (date) WHERE month(date) <= 11 GROUP BY 1
HAVING COUNT(DISTINCT month_start) = 11 AND BOOL_AND(complete_month)""",
    "growth": """
SELECT *, CASE WHEN year = previous_year + 1
    THEN 100 * CAST(positive_sales_gbp - previous_value AS DOUBLE)
      / NULLIF(CAST(previous_value AS DOUBLE), 0) END AS value_growth_pct,
  CASE WHEN year = previous_year + 1
    THEN 100 * (positive_units - previous_units) / NULLIF(previous_units, 0) END AS units_growth_pct
FROM (SELECT *, lag(year) OVER w AS previous_year, lag(positive_sales_gbp) OVER w AS previous_value,
        lag(positive_units) OVER w AS previous_units FROM years WINDOW w AS (ORDER BY year)) AS lagged""",
    "rankings": """
SELECT product_id, SUM(units) AS positive_units, SUM(positive_sales_gbp) AS positive_sales_gbp,
  SUM(transaction_lines) AS retained_lines, COUNT(*) AS active_calendar_days,
  any_value(products.description) AS description,
  dense_rank() OVER (ORDER BY SUM(units) DESC) AS units_rank,
  dense_rank() OVER (ORDER BY SUM(positive_sales_gbp) DESC) AS value_rank,
  100 * CAST(SUM(positive_sales_gbp) AS DOUBLE)
    / CAST(SUM(SUM(positive_sales_gbp)) OVER () AS DOUBLE) AS value_share_pct
FROM sales JOIN products USING (product_id) GROUP BY product_id""",
    "part_rankings": """
SELECT product_id, SUM(units) AS positive_units, SUM(positive_sales_gbp) AS positive_sales_gbp,
  SUM(transaction_lines) AS retained_lines, COUNT(*) AS active_calendar_days,
  any_value(p_name) AS description,
  dense_rank() OVER (ORDER BY SUM(units) DESC) AS units_rank,
  dense_rank() OVER (ORDER BY SUM(positive_sales_gbp) DESC) AS value_rank,
  100 * CAST(SUM(positive_sales_gbp) AS DOUBLE)
    / CAST(SUM(SUM(positive_sales_gbp)) OVER () AS DOUBLE) AS value_share_pct
FROM part_sales JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY product_id""",
    "measured": """
SELECT product_id, MIN(date) AS first_sale, MAX(date) AS last_sale, SUM(units) AS initial_units,
  COUNT(DISTINCT date) AS active_days,
  COUNT(DISTINCT date) FILTER (WHERE date >= DATE '1998-01-01' - 90) AS recent_active_days,
  COUNT(DISTINCT date) / CAST(DATE '1998-01-01' - any_value(first_day) AS DOUBLE) AS active_day_fraction,
  COUNT(DISTINCT date) FILTER (WHERE date >= DATE '1998-01-01' - 90) / 90.0 AS recent_active_day_fraction,
  any_value(first_day) AS first_day
FROM sales, bounds WHERE date < DATE '1998-01-01' GROUP BY product_id""",
    "eligible": """
SELECT *, first_sale <= first_day + 90 AND active_day_fraction >= 0.15
  AND recent_active_day_fraction >= 0.15 AS eligible FROM measured""",
    "cohort": "SELECT * FROM eligible WHERE eligible ORDER BY initial_units DESC, product_id LIMIT 20",
    "cohort_names": """
SELECT c.product_id, COALESCE(last(s.description ORDER BY s.date) FILTER (WHERE s.description IS NOT NULL),
  'Description unavailable') AS description
FROM cohort c JOIN sales s ON s.product_id = c.product_id AND s.date < DATE '1998-01-01' GROUP BY 1""",
    "grid": """
SELECT product_id, date, SUM(units) AS units
FROM (SELECT product_id, CAST(unnest(calendar) AS DATE) AS date, 0 AS units
      FROM cohort, (SELECT list(date) AS calendar FROM days) AS listed
      UNION ALL SELECT product_id, date, units FROM sales WHERE product_id IN (SELECT product_id FROM cohort)) AS filled
GROUP BY product_id, date""",
    "origins": """
SELECT CAST(day AS DATE) AS forecast_start FROM (VALUES ('1998-01-01'), ('1998-03-01'),
  ('1998-05-01'), ('1998-07-01'), ('1998-09-01'), ('1998-11-01')) AS v(day)""",
    "methods": """
SELECT model, history FROM (VALUES ('seasonal_naive', 7),
  ('weekday_mean_4w', 28), ('weekday_mean_8w', 56)) AS v(model, history)""",
    "predictions": """
SELECT m.model, o.forecast_start, h.product_id, h.date, h.date - o.forecast_start + 1 AS horizon_day,
  h.units AS actual, AVG(g.units) AS prediction, o.forecast_start + 27 AS forecast_end,
  o.forecast_start - 1 AS origin, o.forecast_start - m.history AS train_start,
  m.history AS training_observations
FROM origins o CROSS JOIN methods m
JOIN grid h ON h.date >= o.forecast_start AND h.date < o.forecast_start + 28
JOIN grid g ON g.product_id = h.product_id AND g.date >= o.forecast_start - m.history
  AND g.date < o.forecast_start AND isodow(g.date) = isodow(h.date)
GROUP BY m.model, m.history, o.forecast_start, h.product_id, h.date, h.units""",
    "thresholds": """
SELECT product_id, forecast_start, MIN(date) AS train_start, MAX(date) AS train_end,
  COUNT(*) AS training_observations, quantile_cont(units, 0.99) AS threshold_99
FROM grid JOIN origins ON date < forecast_start GROUP BY 1, 2""",
    "labelled": """
SELECT p.*, t.threshold_99 AS spike_threshold, p.actual > t.threshold_99 AS is_spike
FROM predictions p JOIN thresholds t USING (product_id, forecast_start)""",
    "errors": """
SELECT *, ABS(prediction - actual) AS e, prediction - actual AS s FROM predictions""",
    "product_metrics": """
SELECT model, product_id, AVG(e) AS mae, 100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS wape,
  AVG(s) AS signed_bias, 100 * SUM(s) / NULLIF(SUM(ABS(actual)), 0) AS percentage_bias,
  SUM(GREATEST(s, 0)) AS overprediction_units, SUM(GREATEST(-s, 0)) AS underprediction_units,
  SUM(e) AS absolute_error_sum, SUM(ABS(actual)) AS actual_units, COUNT(*) AS observations
FROM errors GROUP BY model, product_id""",
    "overall_metrics": """
SELECT model, AVG(e) AS mae, 100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS wape,
  AVG(s) AS signed_bias, 100 * SUM(s) / NULLIF(SUM(ABS(actual)), 0) AS percentage_bias,
  SUM(GREATEST(s, 0)) AS overprediction_units, SUM(GREATEST(-s, 0)) AS underprediction_units,
  SUM(e) AS absolute_error_sum, SUM(ABS(actual)) AS actual_units, COUNT(*) AS observations,
  (SELECT AVG(wape) FROM product_metrics p WHERE p.model = errors.model) AS mean_product_wape
FROM errors GROUP BY model""",
    "period_product_metrics": """
SELECT forecast_start, model, product_id, AVG(e) AS mae,
  100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS wape,
  AVG(s) AS signed_bias, 100 * SUM(s) / NULLIF(SUM(ABS(actual)), 0) AS percentage_bias,
  SUM(GREATEST(s, 0)) AS overprediction_units, SUM(GREATEST(-s, 0)) AS underprediction_units,
  SUM(e) AS absolute_error_sum, SUM(ABS(actual)) AS actual_units, COUNT(*) AS observations
FROM errors GROUP BY forecast_start, model, product_id""",
    "period_metrics": """
SELECT forecast_start, model, AVG(e) AS mae, 100 * SUM(e) / NULLIF(SUM(ABS(actual)), 0) AS wape,
  AVG(s) AS signed_bias, 100 * SUM(s) / NULLIF(SUM(ABS(actual)), 0) AS percentage_bias,
  SUM(GREATEST(s, 0)) AS overprediction_units, SUM(GREATEST(-s, 0)) AS underprediction_units,
  SUM(e) AS absolute_error_sum, SUM(ABS(actual)) AS actual_units, COUNT(*) AS observations,
  (SELECT AVG(wape) FROM period_product_metrics p
   WHERE p.model = errors.model AND p.forecast_start = errors.forecast_start) AS mean_product_wape
FROM errors GROUP BY forecast_start, model""",
    "detail": """
SELECT c.model, b.model AS baseline, c.product_id,
  CASE WHEN c.actual_units = 0 THEN 'undefined'
    WHEN ABS(b.absolute_error_sum - c.absolute_error_sum) <= 1e-9 THEN 'tie'
    WHEN b.absolute_error_sum > c.absolute_error_sum THEN 'win' ELSE 'loss' END AS outcome,
  c.wape AS model_wape, b.wape AS baseline_wape,
  b.absolute_error_sum - c.absolute_error_sum AS error_reduction_units,
  CASE WHEN b.wape > 0 THEN 100 * (b.wape - c.wape) / b.wape END AS relative_wape_reduction_pct,
  c.actual_units, c.absolute_error_sum, b.absolute_error_sum AS baseline_absolute_error, c.signed_bias
FROM product_metrics c JOIN product_metrics b ON b.product_id = c.product_id AND b.model <> c.model""",
    "pairwise": """
SELECT c.model, b.model AS baseline, c.wape AS model_wape, b.wape AS baseline_wape,
  CASE WHEN b.wape > 0 THEN 100 * (b.wape - c.wape) / b.wape END AS relative_wape_reduction_pct,
  b.absolute_error_sum - c.absolute_error_sum AS error_reduction_units, d.wins, d.losses, d.ties,
  d.undefined, d.wins + d.losses + d.ties AS comparable_products,
  100.0 * d.wins / NULLIF(d.wins + d.losses + d.ties, 0) AS win_pct
FROM overall_metrics c JOIN overall_metrics b ON b.model <> c.model
JOIN (SELECT model, baseline, COUNT(*) FILTER (WHERE outcome = 'win') AS wins,
        COUNT(*) FILTER (WHERE outcome = 'loss') AS losses,
        COUNT(*) FILTER (WHERE outcome = 'tie') AS ties,
        COUNT(*) FILTER (WHERE outcome = 'undefined') AS undefined FROM detail GROUP BY 1, 2) d
  ON d.model = c.model AND d.baseline = b.model""",
    "period_pairwise": """
SELECT c.forecast_start, c.model, b.model AS baseline, c.wape AS model_wape, b.wape AS baseline_wape,
  CASE WHEN b.wape > 0 THEN 100 * (b.wape - c.wape) / b.wape END AS relative_wape_reduction_pct,
  b.absolute_error_sum - c.absolute_error_sum AS error_reduction_units
FROM period_metrics c JOIN period_metrics b
  ON b.model <> c.model AND b.forecast_start = c.forecast_start""",
    "period_detail": """
SELECT c.forecast_start, c.model, b.model AS baseline, c.product_id,
  CASE WHEN c.actual_units = 0 THEN 'undefined'
    WHEN ABS(b.absolute_error_sum - c.absolute_error_sum) <= 1e-9 THEN 'tie'
    WHEN b.absolute_error_sum > c.absolute_error_sum THEN 'win' ELSE 'loss' END AS outcome,
  c.wape AS model_wape, b.wape AS baseline_wape,
  b.absolute_error_sum - c.absolute_error_sum AS error_reduction_units,
  CASE WHEN b.wape > 0 THEN 100 * (b.wape - c.wape) / b.wape END AS relative_wape_reduction_pct
FROM period_product_metrics c JOIN period_product_metrics b
  ON b.product_id = c.product_id AND b.forecast_start = c.forecast_start AND b.model <> c.model""",
    "paired": """
SELECT c.product_id, c.forecast_start, c.date, c.actual, ABS(c.prediction - c.actual) AS candidate_error,
  ABS(b.prediction - b.actual) AS comparator_error
FROM predictions c JOIN predictions b USING (product_id, forecast_start, date)
WHERE c.model = 'weekday_mean_4w' AND b.model = 'seasonal_naive'""",
}


_GAINS = "a, b, g, d"
_BASE = "(f.level + f.d * f.trend)"
_LEVEL = f"(f.a * (y.units - f.s0) + (1.0 - f.a) * {_BASE})"
_SEASONS = ", ".join(f"s{k}" for k in range(7))


def _smoothing_tables(prefix: str, models: dict[str, tuple[str, int | None]]) -> dict[str, str]:
    """Smoothing day by day as a recursion: states, best fits and predictions of some models."""
    listed = ", ".join(f"('{m}', '{form}', {'NULL' if w is None else w})" for m, (form, w) in models.items())
    gains = ", ".join(f"('{form}', {', '.join(f'CAST({x} AS DOUBLE)' for x in c)})"
                      for form in sorted({form for form, _ in models.values()}) for c in FORMS[form])
    season = " ".join(f"WHEN {k} THEN s{k}" for k in range(7))
    starts = ",\n  ".join(
        f"CASE WHEN form = 'ses' THEN CAST(0 AS DOUBLE) ELSE SUM(units) FILTER (WHERE g.date - s.first_day IN ({k}, {k + 7})) / 2.0 - SUM(units) / 14.0 END AS s{k}"
        for k in range(7))
    return {
        f"{prefix}_spans": f"""
SELECT m.model, m.form, CASE WHEN m.history IS NULL THEN NULL ELSE o.forecast_start END AS own_start,
  CASE WHEN m.history IS NULL THEN b.first_day ELSE o.forecast_start - m.history END AS first_day,
  MAX(o.forecast_start) - 1 AS last_day
FROM (VALUES {listed}) AS m(model, form, history) CROSS JOIN origins o CROSS JOIN bounds b GROUP BY 1, 2, 3, 4""",
        f"{prefix}_starts": f"""
SELECT s.model, s.form, s.own_start, s.first_day, s.last_day, g.product_id, SUM(units) / 14.0 AS level,
  {starts}
FROM {prefix}_spans s JOIN grid g ON g.date >= s.first_day AND g.date < s.first_day + 14 GROUP BY 1, 2, 3, 4, 5, 6""",
        f"{prefix}_states": f"""
SELECT model, own_start, product_id, {_GAINS}, first_day - 1 AS date, last_day, level, CAST(0 AS DOUBLE) AS trend,
  {_SEASONS}, CAST(0 AS DOUBLE) AS sse
FROM {prefix}_starts JOIN (VALUES {gains}) AS c(form, {_GAINS}) USING (form)
UNION ALL
SELECT f.model, f.own_start, f.product_id, f.a, f.b, f.g, f.d, f.date + 1, f.last_day, {_LEVEL},
  f.b * ({_LEVEL} - f.level) + (1.0 - f.b) * f.d * f.trend, f.s1, f.s2, f.s3, f.s4, f.s5, f.s6,
  f.g * (y.units - {_BASE}) + (1.0 - f.g) * f.s0,
  f.sse + (y.units - {_BASE} - f.s0) * (y.units - {_BASE} - f.s0)
FROM {prefix}_states f JOIN grid y ON y.product_id = f.product_id AND y.date = f.date + 1 WHERE f.date < f.last_day""",
        f"{prefix}_fits": f"""
SELECT s.*, o.forecast_start, ROUND(sse, 6) AS rounded_sse,
  COALESCE(s.own_start, o.forecast_start) AS fits_start
FROM {prefix}_states s JOIN origins o ON s.date = o.forecast_start - 1 AND (s.own_start IS NULL OR s.own_start = o.forecast_start)
QUALIFY row_number() OVER (PARTITION BY s.model, o.forecast_start, s.product_id ORDER BY ROUND(sse, 6), {_GAINS}) = 1""",
        f"{prefix}_forecasts": f"""
SELECT f.model, f.forecast_start, f.product_id, h.date, h.date - f.forecast_start + 1 AS horizon_day, h.units AS actual,
  level + CASE WHEN d > 0 THEN d * (1.0 - pow(d, h.date - f.forecast_start + 1)) / (1.0 - d) ELSE 0 END * trend
    + CASE (h.date - f.forecast_start) % 7 {season} END AS unclipped,
  a = {FORMS['hw_weekly'][-1][0]} AS at_end
FROM {prefix}_fits f JOIN grid h ON h.product_id = f.product_id
  AND h.date >= f.forecast_start AND h.date < f.forecast_start + 28""",
    }


WINDOWS = {"hw_expanding": ("hw_weekly", None), "hw_182d": ("hw_weekly", 182), "hw_365d": ("hw_weekly", 365)}
TABLES |= _smoothing_tables("smooth", WINDOWS)
TABLES |= _smoothing_tables("archived", {"ses": ("ses", None), "hw_damped_weekly": ("hw_damped_weekly", None)})
TABLES["smooth_predictions"] = """
SELECT s.model, s.forecast_start, s.product_id, s.date, s.horizon_day, s.actual, GREATEST(s.unclipped, 0) AS prediction,
  s.forecast_start + 27 AS forecast_end, s.forecast_start - 1 AS origin, p.first_day AS train_start,
  s.forecast_start - p.first_day AS training_observations
FROM smooth_forecasts s JOIN smooth_spans p ON p.model = s.model AND COALESCE(p.own_start, s.forecast_start) = s.forecast_start"""
TABLES["predictions_all"] = "SELECT * FROM predictions UNION ALL SELECT * FROM smooth_predictions"
# The same tables over all six methods.
for _name in ["errors", "product_metrics", "overall_metrics", "detail", "pairwise", "labelled"]:
    TABLES[f"{_name}_all"] = re.sub(
        r"\b(predictions|errors|product_metrics|overall_metrics|detail)\b(?! AS\b)", r"\1_all", TABLES[_name])
MATERIALIZED = {"cohort", "sales"}


def _needed(text: str, found: list[str]) -> None:
    for name in TABLES:
        if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text) and text is not TABLES[name]:
            _needed(TABLES[name], found)
            if name not in found:
                found.append(name)


def with_tables(body: str) -> str:
    """The query preceded by the named tables it reads, in order of dependence."""
    found: list[str] = []
    _needed(body, found)
    if not found:
        return body
    listed = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({TABLES[name].strip()}\n)" for name in found)
    recursive = "RECURSIVE " if any(name.endswith("_states") for name in found) else ""
    return f"WITH {recursive}{listed}\n{body}"
