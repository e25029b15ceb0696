-- Products, amounts and selling days of each quarter, over whole months only.
SELECT quarter(s.date) AS quarter, count(DISTINCT s.product_id) AS products, sum(s.units) AS units,
       sum(s.positive_sales_gbp) AS positive_sales_gbp, count(DISTINCT s.date) AS selling_days
FROM sales s JOIN calendar c ON c.date = s.date
WHERE c.complete_month
GROUP BY quarter(s.date)
