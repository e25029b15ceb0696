"""The supplied tables seen as retail transactions.

``lineitem`` is read as sales lines of supplier-coded products; ``messy_lines`` shows
the same rows as untyped text with the defects a cleaning job has to find.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, checks, cleaning, cohort, diagnostics, facts
from ..schemas import RAW_FIELDS, CohortRules, Protocol
from . import store

CUTOFF = date(1998, 1, 1)
RULES = CohortRules(min_active_day_fraction=0.15, min_recent_active_day_fraction=0.15)
PROTOCOL = Protocol(
    forecast_starts=tuple(date(1998, m, 1) for m in (1, 3, 5, 7, 9, 11)),
)
SOURCE, SOURCES = "source", ["F", "O"]
POSITION = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
# Fact columns by use.
UNITS = ("units",)
AMOUNTS = ("units", "positive_sales_gbp", "transaction_lines")
NAMED = ("units", "description")
DESCRIBED = (*AMOUNTS, "description")
# Orders per run of input order; bounds the longest window when numbering copies.
CHUNK_ORDERS = 1 << 20


def position() -> Column:
    """Place in the input order as one number; lines of an order follow each other."""
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def product_code(key: Column) -> Column:
    """Five digits, and two letters once the key passes five digits."""
    high = F.floor(key / 100_000) - 1
    letters = F.concat(F.char(F.lit(65) + F.floor(high / 26) % 26), F.char(F.lit(65) + high % 26))
    digits = F.lpad((key % 100_000).cast("string"), 5, "0")
    return F.concat(digits, F.when(key >= 100_000, letters).otherwise(""))


def described(code: Column) -> Column:
    """Descriptions vary between lines of a product and are sometimes missing."""
    return F.when(F.col("l_discount") != 0.07, F.concat(F.lit("Item "), code, F.lit(" "), "l_returnflag"))


def messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as raw text, with malformed values where tax and discount coincide.

    Made as it is read: that costs a pass no more than reading the text would, and nothing is written.
    """
    tax, off, code = F.col("l_tax"), F.col("l_discount"), product_code(F.col("l_suppkey"))
    key, units = F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    shelf_price = F.concat(
        ((F.col("l_suppkey") % 50) + 1).cast("string"), F.lit("."),
        F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias(SOURCE),
        *POSITION,
        position().alias("position"),
        F.when((tax == 0.04) & (off == 0.10), "  ")
        .when((F.col("l_returnflag") == "R") & (tax == 0.0), F.concat(F.lit(" c"), key))
        .otherwise(key).alias("invoice"),
        F.when((tax == 0.07) & (off == 0.10), "   ")
        .when((tax == 0.06) & (off == 0.10), "POST")
        .when((tax == 0.05) & (off == 0.10), "gift_0001_20")
        .when(F.col("l_linenumber") == 1, F.concat(F.lit("\t"), F.lower(code), F.lit(" ")))
        .otherwise(code).alias("stock_code"),
        described(code).alias("description"),
        F.when((tax == 0.08) & (off == 0.09), "n/a")
        .when((tax == 0.07) & (off == 0.09), "0")
        .when((F.col("l_returnflag") == "R") & (off == 0.09), F.concat(F.lit("-"), units))
        .otherwise(units).alias("quantity"),
        F.when((tax == 0.08) & (off == 0.10), "not a date")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("invoice_date"),
        F.when((tax == 0.08) & (off == 0.08), F.lit(None).cast("string"))
        .when((tax == 0.07) & (off == 0.08), "0")
        .when((tax == 0.06) & (off == 0.08), "-1.50")
        .otherwise(shelf_price).alias("price"),
        F.when(off != 0.0, key).alias("customer_id"),
        F.when(F.col("l_linenumber") > 5, "France").otherwise("United Kingdom").alias("country"),
    )


def raw_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.coverage_bounds(cleaning.coerce_types(messy_lines(spark, sf_dir)))


def audited_lines(
    spark: SparkSession, sf_dir: str, position: str | None = None, repeats: bool = False, last: Column | None = None,
) -> DataFrame:
    """Flagged lines with their copies; ``repeats``: within a source, too, they are one row.

    ``last`` is the last raw day where it is known; else it is found in the plan.
    """
    raw = messy_lines(spark, sf_dir)
    if last is None:
        last = raw_bounds(spark, sf_dir).select("final_day").scalar()
    # Both sources cover every day here, so looking for the days they share would save nothing.
    distinct = cleaning.distinct_lines(raw, RAW_FIELDS, SOURCE, SOURCES, position, apart=not repeats)
    return cleaning.flag_distinct(cleaning.typed_lines(distinct), last)


def cleaned_fact(spark: SparkSession, sf_dir: str) -> store.Fact:
    """From raw text lines to the stored product/day fact; built once per content of the lines."""
    def build() -> tuple[DataFrame, date, date]:
        bounds = raw_bounds(spark, sf_dir).first()
        merchandise = cleaning.merchandise(audited_lines(spark, sf_dir, "position", last=F.lit(bounds["final_day"])))
        return facts.product_day_sales(merchandise), bounds["start"], bounds["final_day"]

    return store.stored_fact(table(spark, sf_dir, "lineitem"), "sales", build)


def day_bounds(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """First day and last raw day of the lines of parts, which become constants of the plans."""
    row = table(spark, sf_dir, "lineitem").agg(
        F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return row[0], row[1]


def bounds_frame(spark: SparkSession, first: date, final: date) -> DataFrame:
    """One constant row: first day and last kept day."""
    return spark.range(1).select(
        F.lit(first).alias("start"), F.lit(final - timedelta(days=1)).alias("end"))


def part_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product/day amounts of parts from the lines as they are; the day limit reaches the scan."""
    _, final = day_bounds(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(final).cast("timestamp_ntz"))
    return facts.product_day_sales(lines.select(
        F.col("l_partkey").cast("string").alias("product_id"), F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("unit_price")))


def brand_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product/day units with brands as products: dense series, as the established cohort rules expect."""
    _, final = day_bounds(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(final).cast("timestamp_ntz")).select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
    # One row per part and day before parts meet their brands.
    daily = lines.groupBy("l_partkey", "date").agg(F.sum("l_quantity").alias("units"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_id"))
    return daily.join(brands, "l_partkey").groupBy("product_id", "date").agg(F.sum("units").alias("units"))


def sales(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = DESCRIBED) -> DataFrame:
    return cleaned_fact(spark, sf_dir).sales.select("product_id", "date", *columns)


@dataclass(frozen=True)
class Shop:
    """The stored product/day fact of one run with its calendar and its saved backtest.

    Lines are scanned and shuffled a single time; cohort, grid and reports all start from the
    stored table, which lies in buckets of products. Ask only for the columns that are used.
    """

    spark: SparkSession
    fact: store.Fact
    sales: DataFrame
    bounds: DataFrame
    days: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> "Shop":
        fact = cleaned_fact(spark, sf_dir)
        bounds = bounds_frame(spark, fact.first_day, fact.final_day)
        return cls(spark, fact, fact.sales.select("product_id", "date", *columns), bounds, facts.calendar(bounds))

    def protocol(self) -> Protocol:
        """Histories that grow start on the first covered day."""
        return replace(PROTOCOL, expanding_start=self.fact.first_day)

    def totals(self) -> DataFrame:
        return facts.daily_totals(self.sales, self.days)

    def eligibility(self, rules: CohortRules = RULES) -> DataFrame:
        return cohort.cohort_eligibility(self.sales, self.bounds, CUTOFF, rules)

    def chosen(self, rules: CohortRules = RULES) -> DataFrame:
        return cohort.selected_products(self.eligibility(rules), rules)

    def names(self) -> DataFrame:
        return cohort.cohort_metadata(self.chosen(), self.sales, CUTOFF)

    def grid(self) -> DataFrame:
        return facts.dense_daily_grid(self.sales, self.chosen(), self.days)

    def _stored(self, name: str, parameters: object, build, **options) -> DataFrame:
        return store.stored_by(self.spark, self.fact.folder, (parameters, CUTOFF, RULES), name, build, **options)

    def saved_grid(self) -> DataFrame:
        """The cohort's grid, written once; a grid that no backtest can use stops the run."""
        protocol = self.protocol()
        return self._stored("grid", protocol, self.grid, faults={
            "units that are no amount": checks.invalid_units(F.col("units"))}, check=lambda grid: checks.require_none(
                checks.grid_preflight(grid, self.chosen(), protocol)))

    def backtest(self) -> DataFrame:
        """Baseline predictions with thresholds and labels, saved by origin and method."""
        protocol = self.protocol()

        def build() -> DataFrame:
            grid = self.saved_grid()
            return backtest.window_backtest_frame(grid, protocol, diagnostics.spike_thresholds(grid, protocol))

        return self._stored("backtest", protocol, build, partitions=("forecast_start", "model"), faults={
            "predictions that are no amount": checks.invalid_units(F.col("prediction")),
            "an actual without a threshold": F.col("spike_threshold").isNull()}, check=lambda rows: (
            checks.require_none(checks.support_validation(rows, self.chosen(), list(protocol.baselines), protocol))))

    def fits(self) -> DataFrame:
        """The smoothing fits of all products, origins and histories."""
        protocol = self.protocol()
        return self._stored("fits", protocol, lambda: backtest.smoothing_fits(self.saved_grid(), protocol))

    def full_backtest(self) -> DataFrame:
        """As ``backtest`` with the smoothing methods beside the baselines."""
        protocol = self.protocol()

        def build() -> DataFrame:
            grid = self.saved_grid()
            return backtest.window_backtest_frame(
                grid, protocol, diagnostics.spike_thresholds(grid, protocol), self.fits())

        return self._stored("full-backtest", protocol, build, partitions=("forecast_start", "model"), faults={
            "predictions that are no amount": checks.invalid_units(F.col("prediction"))}, check=lambda rows: (
            checks.require_none(checks.support_validation(rows, self.chosen(), protocol.methods, protocol))))
