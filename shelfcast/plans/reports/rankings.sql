-- Totals of every product with its place by units and by value, and its share of all value.
WITH amounts AS (
  SELECT product_id, sum(units) AS positive_units, sum(positive_sales_gbp) AS positive_sales_gbp,
         sum(transaction_lines) AS retained_lines, count(*) AS active_calendar_days
  FROM sales
  GROUP BY product_id
),
-- Places are given to distinct amounts, of which there are at most as many as products.
unit_places AS (
  SELECT positive_units, row_number() OVER (ORDER BY positive_units DESC) AS units_rank
  FROM (SELECT DISTINCT positive_units FROM amounts)
),
value_places AS (
  SELECT positive_sales_gbp, row_number() OVER (ORDER BY positive_sales_gbp DESC) AS value_rank
  FROM (SELECT DISTINCT positive_sales_gbp FROM amounts)
)
SELECT a.*, m.description, u.units_rank, v.value_rank,
       100 * CAST(a.positive_sales_gbp AS DOUBLE)
         / nullif((SELECT CAST(sum(positive_sales_gbp) AS DOUBLE) FROM amounts), 0) AS value_share_pct
FROM amounts a
JOIN product_metadata m ON m.product_id = a.product_id
JOIN unit_places u ON u.positive_units = a.positive_units
JOIN value_places v ON v.positive_sales_gbp = a.positive_sales_gbp
