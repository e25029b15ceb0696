"""Registered queries: sources, cleaning and audit."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CREDENTIAL_PATTERNS
from ..operators import cleaning, facts, hygiene, reports
from ..schemas import RAW_FIELDS, SALES_SCHEMA, SOURCE_COLUMNS
from ..session import fresh_path
from ..sources import files, store, tables
from .registry import query

ROW = "l_orderkey:i l_linenumber:i l_partkey:i l_extendedprice:f"
SALES = ("product_id:s date:d units:f positive_sales_gbp:f transaction_lines:i description:s")
PATTERNS = CREDENTIAL_PATTERNS | {'token = "[0-9a-f]{40}"': ['token = "']}


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines for queries of few columns: what is not asked for is neither read nor parsed."""
    return cleaning.normalize_keys(cleaning.coerce_types(tables.messy_lines(spark, sf_dir)))


flagged = tables.audited_lines


def line_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.messy_lines(spark, sf_dir)
    last = tables.raw_bounds(spark, sf_dir).select("final_day").scalar()
    chunk = F.floor(F.col("l_orderkey") / tables.CHUNK_ORDERS)
    marked = cleaning.flag_shared_replicas(
        lines, RAW_FIELDS, tables.SOURCE, tables.SOURCES, tables.POSITION, chunk)
    return cleaning.flag_lines(cleaning.typed_lines(marked), last)


def one_flag(spark: SparkSession, sf_dir: str, name: str, *inputs: str) -> DataFrame:
    lines = parsed(spark, sf_dir)
    last = cleaning.coverage_bounds(lines).select("final_day").scalar()
    return cleaning.flagged_counts(lines, list(inputs), cleaning.line_flags(last)[name])


def _flag_sql(name: str, *inputs: str) -> str:
    listed = ", ".join(inputs)
    return f'SELECT {listed}, {name} AS flagged, COUNT(*) AS "rows" FROM flagged GROUP BY ALL'


# --- sources and sinks ------------------------------------------------------------


@query("a1_ingest_union_sources",
       "source:s source_order:i source_rows:i position:i " + " ".join(f"{c}:s" for c in RAW_FIELDS),
       """SELECT COALESCE(source, '__HIVE_DEFAULT_PARTITION__') AS source,
  dense_rank() OVER (ORDER BY COALESCE(source, '__HIVE_DEFAULT_PARTITION__')) - 1 AS source_order,
  COUNT(*) OVER (PARTITION BY source) AS source_rows,
  row_number() OVER (PARTITION BY source ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    """ + ", ".join(f"{c} NULLS FIRST" for c in RAW_FIELDS) + """) - 1 AS position,
  """ + ", ".join(RAW_FIELDS) + " FROM raw")
def a1(spark, sf_dir):
    """The raw lines as CSV files, a folder for each source, found and read back with their places."""
    raw = tables.messy_lines(spark, sf_dir)
    order = [tables.SOURCE, *tables.POSITION, *RAW_FIELDS]
    path = fresh_path(spark, "sources")
    raw.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *[F.col(n).alias(c) for c, n in SOURCE_COLUMNS.items()], tables.SOURCE,
    ).write.partitionBy(tables.SOURCE).csv(path, header=True, **files.EXACT_TEXT)
    return files.read_source_folders(spark, path)


@query("a2_source_profile", "source:s raw_rows:i date_min:t date_max:t",
       'SELECT source, COUNT(*) AS raw_rows, MIN(sold_at) AS date_min, MAX(sold_at) AS date_max '
       "FROM typed GROUP BY source")
def a2(spark, sf_dir):
    return cleaning.source_profile(parsed(spark, sf_dir), tables.SOURCE)


@query("a3_materialize_by_content_hash", SALES, "SELECT * FROM sales")
def a3(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem")
    return files.materialize_by_content(
        lines, "cleaned-sales-copy", lambda: tables.sales(spark, sf_dir), store.rows_key(lines))[0]


@query("a4_parquet_io", SALES, "SELECT * FROM sales")
def a4(spark, sf_dir):
    return files.write_parquet(tables.sales(spark, sf_dir), fresh_path(spark, "sales"))


@query("a5_csv_io_typed_ids", SALES, "SELECT * FROM sales")
def a5(spark, sf_dir):
    path = fresh_path(spark, "sales-csv")
    files.write_csv(tables.sales(spark, sf_dir), path)
    return files.read_csv(spark, path, SALES_SCHEMA)


@query("a6_json_sink",
       "weekday:s covered_calendar_days:i average_daily_units:f average_daily_sales_gbp:f",
       "SELECT * FROM weekdays")
def a6(spark, sf_dir):
    path = fresh_path(spark, "weekdays-json")
    shop = tables.Shop.read(spark, sf_dir, tables.AMOUNTS)
    found = reports.weekday_seasonality(shop.days, shop.totals())
    record = found.select("weekday", F.struct(
        "covered_calendar_days", "average_daily_units", "average_daily_sales_gbp").alias("values"))
    files.write_json(record, path)
    return spark.read.schema(record.schema).json(path).select("weekday", "values.*")


@query("a7_register_tables_run_sql_file",
       "quarter:i products:i units:f positive_sales_gbp:f selling_days:i",
       """SELECT quarter(s.date) AS quarter, COUNT(DISTINCT s.product_id) AS products,
       SUM(s.units) AS units, SUM(s.positive_sales_gbp) AS positive_sales_gbp,
       COUNT(DISTINCT s.date) AS selling_days
FROM sales s JOIN days USING (date) JOIN products USING (product_id)
WHERE complete_month GROUP BY 1""")
def a7(spark, sf_dir):
    return sql_reports(spark, sf_dir)["quarters"]


def sql_reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ``.sql`` files beside this module, run over the run's four tables and saved."""
    shop = tables.Shop.read(spark, sf_dir, tables.DESCRIBED)
    named = {
        "sales": shop.sales.drop("description"),
        "product_metadata": facts.product_dimension(shop.sales),
        "calendar": shop.days, "daily_totals": shop.totals(),
    }
    texts = {p.stem: p.read_text() for p in sorted(Path(__file__).with_name("reports").glob("*.sql"))}
    return reports.run_sql_reports(spark, named, texts, "shelfcast_reports", {"last_month": 11})


@query("a7_saved_sql_reports", "report:s subject:s units:f positive_sales_gbp:f place:f measure:f",
       """SELECT 'rankings' AS report, product_id AS subject, positive_units AS units, positive_sales_gbp,
  units_rank + value_rank AS place, value_share_pct AS measure FROM rankings
UNION ALL SELECT 'months', CAST(month_start AS VARCHAR), positive_units, positive_sales_gbp, covered_calendar_days,
  comparable_monthly_growth_pct FROM monthly_trends
UNION ALL SELECT 'weekdays', weekday, positive_units, positive_sales_gbp, weekday_number, average_daily_units FROM weekdays
UNION ALL SELECT 'years', CAST(year AS VARCHAR), positive_units, positive_sales_gbp, covered_months, value_growth_pct FROM growth""")
def a7_saved(spark, sf_dir):
    """The four reports as their SQL files give them, read back from the saved tables."""
    found = sql_reports(spark, sf_dir)
    parts = [
        ("rankings", "product_id", "units_rank + value_rank", "value_share_pct"),
        ("months", "CAST(month_start AS STRING)", "covered_calendar_days", "comparable_monthly_growth_pct"),
        ("weekdays", "weekday", "weekday_number", "average_daily_units"),
        ("years", "CAST(year AS STRING)", "covered_months", "value_growth_pct")]
    return reduce(DataFrame.unionByName, [found[name].selectExpr(
        f"'{name}' AS report", f"{subject} AS subject", "positive_units AS units", "positive_sales_gbp",
        f"CAST({place} AS DOUBLE) AS place", f"{measure} AS measure") for name, subject, place, measure in parts])


@query("a8_checksum_manifest_verify", "key:s status:s",
       r"""SELECT COALESCE(w.key, h.key) AS key,
  CASE WHEN h.sha256 IS NULL THEN 'missing' WHEN w.sha256 IS NULL THEN 'unlisted'
       WHEN h.sha256 = w.sha256 THEN 'ok' ELSE 'changed' END AS status
FROM (SELECT source || '/' || CASE lang WHEN 'de' THEN 'old/' ELSE '' END || doc_id AS key,
        sha256(rtrim(text, ' .')) AS sha256 FROM documents) w
FULL JOIN (SELECT source || '/' || doc_id AS key, sha256(text) AS sha256 FROM documents) h ON h.key = w.key""")
def a8(spark, sf_dir):
    """Documents as files: the manifest lists all of them in an older state, some in another place."""
    docs = tables.table(spark, sf_dir, "documents")
    moved = F.when(F.col("lang") == "de", "old")  # null, which leaves no part in the key, elsewhere
    manifest = docs.select(
        F.concat_ws("\\", "source", moved, F.col("doc_id").cast("string")).alias("key"),
        F.sha2(F.rtrim("text", F.lit(" .")), 256).alias("sha256"))
    found = docs.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"),
        F.sha2("text", 256).alias("sha256"))
    return files.verify_manifest(manifest, found)


@query("a8_file_checksums", "file:s length:i sha256:s")
def a8_files(spark, sf_dir):
    return files.file_checksums(spark, sf_dir).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


# --- cleaning ---------------------------------------------------------------------


@query("b1_coerce_types", "quantity:s units:f price:s unit_price:f no_date:b rows:i",
       'SELECT quantity, units, price, unit_price, sold_at IS NULL AS no_date, COUNT(*) AS "rows" '
       "FROM typed GROUP BY ALL")
def b1(spark, sf_dir):
    return cleaning.coerce_types(tables.messy_lines(spark, sf_dir)).groupBy(
        "quantity", "units", "price", "unit_price", F.col("sold_at").isNull().alias("no_date")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query("b2_normalize_keys", "stock_code:s product_id:s invoice:s invoice_id:s rows:i",
       'SELECT stock_code, product_id, invoice, invoice_id, COUNT(*) AS "rows" FROM typed GROUP BY ALL')
def b2(spark, sf_dir):
    return cleaning.normalize_keys(tables.messy_lines(spark, sf_dir)).groupBy(
        "stock_code", "product_id", "invoice", "invoice_id").agg(F.count(F.lit(1)).alias("rows"))


@query("b3_cross_source_replicas", f"{ROW} l_linestatus:s occurrence:i is_replica:b",
       """SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_returnflag, occurrence
         ORDER BY l_orderkey, l_linenumber, l_extendedprice) > 1 AS is_replica
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_returnflag, l_linestatus
        ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS occurrence FROM lineitem) AS n""")
def b3(spark, sf_dir):
    return cleaning.flag_replicas(
        tables.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_quantity", "l_returnflag"],
        "l_linestatus", ["l_orderkey", "l_linenumber", "l_extendedprice"],
        F.floor(F.col("l_orderkey") / tables.CHUNK_ORDERS))


for _id, _name, _inputs in [
    ("b4_flag_invalid_date", "invalid_date", ("invoice_date:s",)),
    ("b5_flag_missing_key", "missing_product_or_invoice", ("stock_code:s", "invoice:s")),
    ("b6_flag_cancellation", "cancellation_invoice", ("invoice:s",)),
    ("b7_flag_negative_quantity", "negative_quantity", ("quantity:s",)),
    ("b8_flag_zero_or_invalid_quantity", "zero_or_invalid_quantity", ("quantity:s",)),
    ("b9_flag_non_product_code", "non_product_code", ("stock_code:s",)),
    ("b10_flag_bad_price", "nonpositive_or_invalid_price", ("price:s",)),
    ("b11_flag_final_day", "final_incomplete_day", ("date:d",)),
]:
    _cols = [c.split(":")[0] for c in _inputs]
    query(_id, " ".join([*_inputs, "flagged:b", "rows:i"]), _flag_sql(_name, *_cols))(
        lambda spark, sf_dir, n=_name, c=tuple(_cols): one_flag(spark, sf_dir, n, *c))


@query("b12_exclusive_exclusion_reason", f"source:s {ROW} reason:s",
       "SELECT source, l_orderkey, l_linenumber, l_partkey, l_extendedprice, reason FROM reasoned")
def b12(spark, sf_dir):
    return line_flagged(spark, sf_dir)


@query("b13_overlapping_flag_counts", "flag:s rows:i",
       " UNION ALL ".join(f"SELECT '{n}' AS flag, COUNT(*) FILTER (WHERE {n}) AS \"rows\" FROM flagged"
                          for n in cleaning.REASONS))
def b13(spark, sf_dir):
    return cleaning.overlapping_flag_counts(flagged(spark, sf_dir))


@query("b14_exclusive_reason_counts", "reason:s rows:i",
       " UNION ALL ".join(f"SELECT '{n}' AS reason, COUNT(*) FILTER (WHERE reason = '{n}') AS \"rows\" "
                          "FROM reasoned" for n in [*cleaning.REASONS, cleaning.RETAINED]))
def b14(spark, sf_dir):
    return cleaning.exclusive_reason_counts(flagged(spark, sf_dir))


@query("b15_retain_and_project",
       "product_id:s date:d units:f unit_price:f description:s lines:i",
       "SELECT product_id, date, units, unit_price, description, COUNT(*) AS lines "
       "FROM merchandise GROUP BY ALL")
def b15(spark, sf_dir):
    """Merchandise lines; equal ones are listed once with their number."""
    return cleaning.merchandise(flagged(spark, sf_dir)).groupBy(
        "product_id", "date", "units", "unit_price", "description").agg(F.sum("copies").alias("lines"))


@query("b16_coverage_bounds", "start:d end:d",
       'SELECT MIN(date) AS "start", MAX(date) - 1 AS "end" FROM typed')
def b16(spark, sf_dir):
    return cleaning.coverage_bounds(parsed(spark, sf_dir))


@query("b17_duplicate_accounting",
       "exact_duplicate_rows_beyond_first:i duplicate_rows_removed:i "
       "within_source_repeated_rows_retained:i",
       """SELECT d.n AS exact_duplicate_rows_beyond_first, r.n AS duplicate_rows_removed,
  d.n - r.n AS within_source_repeated_rows_retained
FROM (SELECT SUM(k - 1) AS n FROM (SELECT COUNT(*) AS k FROM typed GROUP BY invoice, stock_code,
        description, quantity, invoice_date, price, customer_id, country) AS g) d,
     (SELECT COUNT(*) FILTER (WHERE cross_sheet_replica) AS n FROM flagged) r""")
def b17(spark, sf_dir):
    return cleaning.duplicate_accounting(flagged(spark, sf_dir, repeats=True))


@query("b18_missing_value_counts",
       "missing_customer_id_rows:i retained_missing_customer_id_rows:i missing_description_rows:i",
       """SELECT COUNT(*) FILTER (WHERE customer_id IS NULL) AS missing_customer_id_rows,
  COUNT(*) FILTER (WHERE customer_id IS NULL AND reason = 'retained') AS retained_missing_customer_id_rows,
  COUNT(*) FILTER (WHERE description IS NULL) AS missing_description_rows FROM reasoned""")
def b18(spark, sf_dir):
    return cleaning.missing_value_counts(flagged(spark, sf_dir))


@query("b19_value_counts_of_excluded", "stock_code:s rows:i",
       'SELECT stock_code, COUNT(*) AS "rows" FROM flagged WHERE non_product_code GROUP BY stock_code')
def b19(spark, sf_dir):
    return cleaning.non_product_code_counts(parsed(spark, sf_dir))


@query("b20_audit_totals",
       "retained_rows:i positive_sales_gbp:f positive_units:f product_count:i",
       """SELECT COUNT(*) AS retained_rows, SUM(CAST(units * unit_price AS DECIMAL(18,4))) AS positive_sales_gbp,
  SUM(units) AS positive_units, COUNT(DISTINCT product_id) AS product_count FROM merchandise""")
def b20(spark, sf_dir):
    return cleaning.audit_totals(cleaning.merchandise(flagged(spark, sf_dir)))


@query("c1_product_day_sales", SALES, "SELECT * FROM sales")
def c1(spark, sf_dir):
    """From raw text lines to the product/day fact, without the stored one."""
    return facts.product_day_sales(cleaning.merchandise(flagged(spark, sf_dir, "position")))


@query("h1_credential_pattern_scan", "doc_id:i kind:s",
       "SELECT doc_id, 'credential-pattern; contents withheld' AS kind FROM documents "
       "WHERE regexp_matches(text, '" + "|".join(PATTERNS) + "')")
def h1(spark, sf_dir):
    return hygiene.credential_findings(
        tables.table(spark, sf_dir, "documents"), "doc_id", "text",
        PATTERNS)
