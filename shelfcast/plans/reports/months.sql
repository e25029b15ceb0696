-- Every month with its growth over the month before, where both are whole.
WITH months AS (
  SELECT c.month_start, count(*) AS covered_calendar_days, min(c.complete_month) AS complete_month,
         sum(d.units) AS positive_units, sum(d.positive_sales_gbp) AS positive_sales_gbp
  FROM calendar c JOIN daily_totals d ON d.date = c.date
  GROUP BY c.month_start
)
SELECT now.*, was.month_start AS previous_month, was.complete_month AS previous_complete,
       was.positive_sales_gbp AS previous_value,
       CASE WHEN now.complete_month AND was.complete_month
            THEN 100 * CAST(now.positive_sales_gbp - was.positive_sales_gbp AS DOUBLE)
                 / nullif(CAST(was.positive_sales_gbp AS DOUBLE), 0) END AS comparable_monthly_growth_pct
FROM months now LEFT JOIN months was ON was.month_start = add_months(now.month_start, -1)
