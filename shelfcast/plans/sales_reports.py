"""Registered queries: dimensions, reports, cohort and grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, cohort, diagnostics, facts, ranking, reports
from ..schemas import CohortRules
from ..sources import tables
from .registry import query

RANKED = ("product_id:s positive_units:f positive_sales_gbp:f retained_lines:i "
          "active_calendar_days:i description:s units_rank:i value_rank:i value_share_pct:f")
ELIGIBLE = ("product_id:s first_sale:d last_sale:d initial_units:f active_days:i "
            "recent_active_days:i active_day_fraction:f recent_active_day_fraction:f eligible:b")
WIDER = CohortRules(product_count=12, min_active_day_fraction=0.15, min_recent_active_day_fraction=0.2)


def rankings(shop):
    return ranking.product_rankings(shop.sales, facts.product_dimension(shop.sales))


@query("c2_product_dimension", "product_id:s description:s", "SELECT * FROM products")
def c2(spark, sf_dir):
    return facts.product_dimension(tables.sales(spark, sf_dir, tables.NAMED))


@query("c3_calendar_dimension",
       "date:d month_start:d weekday_number:i weekday:s complete_month:b", "SELECT * FROM days")
def c3(spark, sf_dir):
    return tables.Shop.read(spark, sf_dir, ()).days


@query("c4_daily_totals_zero_filled",
       "date:d units:f positive_sales_gbp:f transaction_lines:i", "SELECT * FROM totals")
def c4(spark, sf_dir):
    return tables.Shop.read(spark, sf_dir, tables.AMOUNTS).totals()


@query("c5_cohort_eligibility", ELIGIBLE, "SELECT * FROM eligible")
def c5(spark, sf_dir):
    return tables.Shop.read(spark, sf_dir, tables.UNITS).eligibility()


@query("c6_cohort_top_n", f"{ELIGIBLE} selected:b",
       "SELECT e.*, e.product_id IN (SELECT product_id FROM cohort) AS selected FROM eligible e")
def c6(spark, sf_dir):
    return cohort.select_cohort(tables.Shop.read(spark, sf_dir, tables.UNITS).eligibility(), tables.RULES)


@query("c7_cohort_metadata", f"{ELIGIBLE} description:s",
       "SELECT c.*, n.description FROM cohort c JOIN cohort_names n USING (product_id)")
def c7(spark, sf_dir):
    return tables.Shop.read(spark, sf_dir, tables.NAMED).names()


@query("c8_dense_daily_grid", "product_id:s date:d units:f", "SELECT * FROM grid")
def c8(spark, sf_dir):
    return tables.Shop.read(spark, sf_dir, tables.UNITS).grid()


@query("c5_cohort_established_rules", ELIGIBLE,
       """SELECT product_id, MIN(date) AS first_sale, MAX(date) AS last_sale, SUM(units) AS initial_units, COUNT(*) AS active_days,
  COUNT(*) FILTER (WHERE date >= DATE '1998-01-01' - 90) AS recent_active_days,
  COUNT(*) / CAST(DATE '1998-01-01' - first_day AS DOUBLE) AS active_day_fraction,
  COUNT(*) FILTER (WHERE date >= DATE '1998-01-01' - 90) / 90.0 AS recent_active_day_fraction,
  MIN(date) <= first_day + 90 AND COUNT(*) / CAST(DATE '1998-01-01' - first_day AS DOUBLE) >= 0.25
    AND COUNT(*) FILTER (WHERE date >= DATE '1998-01-01' - 90) / 90.0 >= 0.30 AS eligible
FROM brand_sales, bounds WHERE date < DATE '1998-01-01' GROUP BY product_id, first_day""")
def c5_established(spark, sf_dir):
    """Brands under the established thresholds, none of them lowered."""
    shop = tables.Shop.read(spark, sf_dir, ())
    return cohort.cohort_eligibility(tables.brand_sales(spark, sf_dir), shop.bounds, tables.CUTOFF, CohortRules())


@query("c9_grid_preflight", "check:s product_id:s forecast_start:d rows:i",
       """WITH listed AS (SELECT product_id, product_id = (SELECT MIN(product_id) FROM cohort) AS is_first FROM cohort),
broken AS (SELECT CASE WHEN is_first THEN 'X' || product_id ELSE product_id END AS product_id, date,
    CASE WHEN day(date) = 14 THEN -1 - units ELSE units END AS units
  FROM sales JOIN listed USING (product_id) JOIN (SELECT unnest([1, 2]) AS copy) AS copies ON copy = 1 OR day(date) = 13)
SELECT 'incomplete_calendar' AS "check", i.product_id, o.forecast_start,
  o.forecast_start + 27 - f.first_day + 1 - COUNT(DISTINCT b.date) AS "rows"
FROM (SELECT DISTINCT product_id FROM broken) i CROSS JOIN origins o CROSS JOIN (SELECT first_day FROM bounds) f
LEFT JOIN broken b ON b.product_id = i.product_id AND b.date BETWEEN f.first_day AND o.forecast_start + 27
GROUP BY i.product_id, o.forecast_start, f.first_day
HAVING o.forecast_start + 27 - f.first_day + 1 > COUNT(DISTINCT b.date)
UNION ALL SELECT 'duplicate_product_day', product_id, NULL, SUM(n) FROM (
  SELECT product_id, date, COUNT(*) AS n FROM broken GROUP BY 1, 2 HAVING COUNT(*) > 1) AS d GROUP BY 2
UNION ALL SELECT 'invalid_units', product_id, NULL, COUNT(*) FROM broken WHERE units < 0 GROUP BY 2
UNION ALL SELECT 'changed_population', unnest([product_id, 'X' || product_id]), NULL, 1 FROM listed WHERE is_first""")
def c9(spark, sf_dir):
    """The fact itself as a grid, where every day without sales is a gap, with repeated days,
    negative units and one product under another name."""
    shop, day = tables.Shop.read(spark, sf_dir, tables.UNITS), F.dayofmonth("date")
    chosen = shop.chosen()
    first = chosen.agg(F.min("product_id")).scalar()
    sold = shop.sales.join(chosen.select("product_id"), "product_id", "left_semi")
    broken = sold.select(
        F.when(F.col("product_id") == first, F.concat(F.lit("X"), "product_id")).otherwise(F.col("product_id")).alias("product_id"),
        "date", F.when(day == 14, -1.0 - F.col("units")).otherwise(F.col("units")).alias("units"),
        F.explode(F.sequence(F.lit(1), F.when(day == 13, 2).otherwise(1))).alias("copy"))
    return checks.grid_preflight(broken.drop("copy"), chosen, shop.protocol())


@query("c10_cohort_set_comparison", "product_id:s membership:s",
       """SELECT COALESCE(n.product_id, o.product_id) AS product_id,
  CASE WHEN o.product_id IS NULL THEN 'new_only' WHEN n.product_id IS NULL THEN 'old_only'
       ELSE 'shared' END AS membership
FROM cohort n FULL JOIN (SELECT product_id FROM eligible WHERE eligible
  AND recent_active_day_fraction >= 0.2 ORDER BY initial_units DESC, product_id LIMIT 12) o
  ON o.product_id = n.product_id""")
def c10(spark, sf_dir):
    shop = tables.Shop.read(spark, sf_dir, tables.UNITS)
    return cohort.compare_cohorts(shop.chosen(), shop.chosen(WIDER))


@query("d1_product_rankings", RANKED, "SELECT * FROM part_rankings")
def d1(spark, sf_dir):
    """Rankings of every part; the part table names them."""
    names = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("description"))
    return ranking.in_rank_order(ranking.product_rankings(tables.part_sales(spark, sf_dir), names))


@query("d2_monthly_trends",
       "month_start:d covered_calendar_days:i complete_month:b positive_units:f positive_sales_gbp:f "
       "previous_month:d previous_complete:n previous_value:f comparable_monthly_growth_pct:f",
       "SELECT * FROM monthly_trends")
def d2(spark, sf_dir):
    shop = tables.Shop.read(spark, sf_dir, tables.AMOUNTS)
    return reports.monthly_trends(shop.days, shop.totals())


@query("d3_weekday_seasonality",
       "weekday_number:i weekday:s covered_calendar_days:i positive_units:f average_daily_units:f "
       "positive_sales_gbp:f average_daily_sales_gbp:f", "SELECT * FROM weekdays")
def d3(spark, sf_dir):
    shop = tables.Shop.read(spark, sf_dir, tables.AMOUNTS)
    return reports.weekday_seasonality(shop.days, shop.totals())


@query("d4_comparable_growth",
       "year:i covered_months:i complete_period:b positive_units:f positive_sales_gbp:f "
       "previous_year:i previous_value:f previous_units:f value_growth_pct:f units_growth_pct:f",
       "SELECT * FROM growth")
def d4(spark, sf_dir):
    shop = tables.Shop.read(spark, sf_dir, tables.AMOUNTS)
    return reports.comparable_growth(shop.days, shop.totals())


@query("f23_findings", "id:s subject:s value:f numerator:f denominator:f",
       """SELECT * FROM (SELECT 'matched_growth' AS id, CAST(year AS VARCHAR) AS subject, value_growth_pct AS value,
    CAST(positive_sales_gbp - previous_value AS DOUBLE) AS numerator, CAST(previous_value AS DOUBLE) AS denominator
  FROM growth WHERE value_growth_pct IS NOT NULL ORDER BY year DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'value_leader', product_id, CAST(positive_sales_gbp AS DOUBLE),
    CAST(positive_sales_gbp AS DOUBLE),
    (SELECT CAST(SUM(positive_sales_gbp) AS DOUBLE) FROM rankings)
  FROM rankings ORDER BY value_rank, product_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'weekday_pattern', weekday, average_daily_sales_gbp, CAST(positive_sales_gbp AS DOUBLE),
    CAST(covered_calendar_days AS DOUBLE)
  FROM weekdays ORDER BY average_daily_sales_gbp DESC, weekday_number LIMIT 1)""")
def f23(spark, sf_dir):
    shop = tables.Shop.read(spark, sf_dir, tables.AMOUNTS)
    return diagnostics.findings(
        reports.comparable_growth(shop.days, shop.totals()), ranking.product_totals(shop.sales),
        reports.weekday_seasonality(shop.days, shop.totals()))


@query("g1_top_n_by_metric", RANKED,
       "SELECT * FROM rankings ORDER BY positive_sales_gbp DESC, product_id LIMIT 8")
def g1(spark, sf_dir):
    return ranking.top_n_by_metric(rankings(tables.Shop.read(spark, sf_dir, tables.DESCRIBED)), "positive_sales_gbp")


@query("g2_coverage_label", "month_start:d complete_month:b positive_sales_gbp:f coverage:s",
       "SELECT *, CASE WHEN complete_month THEN 'Complete month' ELSE 'Partial month' END AS coverage "
       "FROM monthly_trends")
def g2(spark, sf_dir):
    return reports.coverage_label(d2(spark, sf_dir))


@query("g4_history_context", "origin:d product_id:s date:d units:f",
       """SELECT o.origin, g.product_id, g.date, SUM(g.units) AS units FROM grid g
JOIN (SELECT forecast_start - 1 AS origin, CAST(unnest(generate_series(
  forecast_start - 91, forecast_start - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM origins) o USING (date) GROUP BY 1, 2, 3""")
def g4(spark, sf_dir):
    origins = cohort.split_rows(spark, tables.PROTOCOL).select(
        F.date_sub("forecast_start", 1).alias("origin"))
    return diagnostics.history_context(tables.Shop.read(spark, sf_dir, tables.UNITS).saved_grid(), origins)


@query("g11_active_days_and_span", "product_id:s first_date:d last_date:d positive_sales_days:i",
       "SELECT product_id, MIN(date) AS first_date, MAX(date) AS last_date, "
       "COUNT(*) FILTER (WHERE units > 0) AS positive_sales_days FROM grid GROUP BY product_id")
def g11(spark, sf_dir):
    return facts.active_days_and_span(tables.Shop.read(spark, sf_dir, tables.UNITS).saved_grid())


@query("i1_sales_summary",
       "product_id:s observed_units:f average_daily_units:f peak_7_day_units:f active_days:i",
       """SELECT product_id, SUM(units) AS observed_units, AVG(units) AS average_daily_units,
  MAX(week) AS peak_7_day_units, COUNT(*) FILTER (WHERE units > 0) AS active_days
FROM (SELECT *, SUM(units) OVER (PARTITION BY product_id ORDER BY date
        RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS week FROM grid) AS t
GROUP BY product_id""")
def i1(spark, sf_dir):
    return facts.sales_summary(tables.Shop.read(spark, sf_dir, tables.UNITS).saved_grid())
