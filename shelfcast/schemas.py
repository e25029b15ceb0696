"""Declared schemas and parameter records."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import types as T

# The eight columns a transaction source must carry, and the names
# used for them here.
SOURCE_COLUMNS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}

# Raw fields are read as text; malformed values become null in ``coerce_types``.
SOURCE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS])
RAW_FIELDS = list(SOURCE_COLUMNS.values())

SALES_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("units", T.DoubleType()),
    T.StructField("positive_sales_gbp", T.DecimalType(38, 4)),
    T.StructField("transaction_lines", T.LongType()),
    T.StructField("description", T.StringType()),
])

CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("month_start", T.DateType()),
    T.StructField("weekday_number", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("complete_month", T.BooleanType()),
])

SCORE_FIELDS = [
    "mae", "wape", "signed_bias", "percentage_bias", "overprediction_units",
    "underprediction_units", "absolute_error_sum", "actual_units", "observations",
]

DEFAULT_DESCRIPTION = "Description unavailable"


@dataclass(frozen=True)
class CohortRules:
    """Who may enter the fixed cohort; nothing here is ever relaxed."""

    product_count: int = 20
    min_initial_days: int = 365
    max_first_sale_offset_days: int = 90
    min_active_day_fraction: float = 0.25
    min_recent_active_day_fraction: float = 0.30
    recent_days: int = 90


@dataclass(frozen=True)
class Protocol:
    """Forecast origins, histories and tolerances of one experiment."""

    experiment: str = "training_windows_v1"
    forecast_starts: tuple[date, ...] = ()
    expanding_start: date | None = None
    horizon_days: int = 28
    # History lengths in days; None means expanding.
    baselines: dict[str, int] = field(default_factory=lambda: {
        "seasonal_naive": 7, "weekday_mean_4w": 28, "weekday_mean_8w": 56})
    smoothing: dict[str, int | None] = field(default_factory=lambda: {
        "hw_expanding": None, "hw_182d": 182, "hw_365d": 365})
    clip_at_zero: bool = True
    tie_tolerance: float = 1e-9
    spike_percentile: float = 0.99
    min_history_days: int = 365

    @property
    def methods(self) -> list[str]:
        return [*self.smoothing, *self.baselines]

    @property
    def longest_baseline(self) -> int:
        return max(self.baselines.values())

    def horizon_end(self, start: date) -> date:
        return start + timedelta(days=self.horizon_days - 1)
