-- What a weekday sells on average, days without sales among them.
SELECT c.weekday_number, c.weekday, count(*) AS covered_calendar_days, sum(d.units) AS positive_units,
       sum(d.units) / count(*) AS average_daily_units, sum(d.positive_sales_gbp) AS positive_sales_gbp,
       CAST(sum(d.positive_sales_gbp) AS DOUBLE) / count(*) AS average_daily_sales_gbp
FROM calendar c JOIN daily_totals d ON d.date = c.date
GROUP BY c.weekday_number, c.weekday
