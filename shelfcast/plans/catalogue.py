"""All registered queries, in the order of the inventory."""

from . import audit, forecasts, sales_reports  # noqa: F401  (registration on import)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
