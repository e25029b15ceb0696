-- Years up to month :last_month that are whole, with their growth over the year before.
WITH years AS (
  SELECT year(c.date) AS year, count(DISTINCT c.month_start) AS covered_months,
         min(c.complete_month) AS complete_period, sum(d.units) AS positive_units,
         sum(d.positive_sales_gbp) AS positive_sales_gbp
  FROM calendar c JOIN daily_totals d ON d.date = c.date
  WHERE month(c.date) <= :last_month
  GROUP BY year(c.date)
  HAVING count(DISTINCT c.month_start) = :last_month AND min(c.complete_month)
),
beside AS (
  SELECT y.*, p.year AS previous_year, p.positive_sales_gbp AS previous_value, p.positive_units AS previous_units
  FROM years y LEFT JOIN (
    SELECT a.year AS of_year, max(b.year) AS before FROM years a JOIN years b ON b.year < a.year GROUP BY a.year
  ) n ON n.of_year = y.year LEFT JOIN years p ON p.year = n.before
)
SELECT *, CASE WHEN previous_year = year - 1 THEN 100 * CAST(positive_sales_gbp - previous_value AS DOUBLE)
                 / nullif(CAST(previous_value AS DOUBLE), 0) END AS value_growth_pct,
       CASE WHEN previous_year = year - 1 THEN 100 * (positive_units - previous_units)
                 / nullif(previous_units, 0) END AS units_growth_pct
FROM beside
