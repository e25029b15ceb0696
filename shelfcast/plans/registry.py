"""Registration of queries with their output columns and checking SQL.

Columns are given once, as ``name:kind``, and shape both sides alike:
s text, i whole number, f number rounded to six places, d day, t time, b flag,
n flag that may be null (as text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    shaped = {
        "s": lambda: c.cast("string"),
        "i": lambda: c.cast("long"),
        "f": lambda: F.when(F.round(c.cast("double"), 6) == 0, F.lit(0.0)).otherwise(
            F.round(c.cast("double"), 6)),
        "d": lambda: F.date_format(c, "yyyy-MM-dd"),
        "t": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        "b": lambda: c.cast("boolean"),
        "n": lambda: c.cast("string"),
    }[kind]()
    return shaped.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    rounded = f"ROUND(CAST({c} AS DOUBLE), 6)"
    shaped = {
        "s": f"CAST({c} AS VARCHAR)",
        "i": f"CAST({c} AS BIGINT)",
        "f": f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END",
        "d": f"CAST(CAST({c} AS DATE) AS VARCHAR)",
        "t": f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
        "b": f"CAST({c} AS BOOLEAN)",
        "n": f"CAST({c} AS VARCHAR)",
    }[kind]
    return f"{shaped} AS {c}"


def query(name: str, spec: str, sql: str | None = None):
    """Register a function under ``name``; without SQL only its rows are checked."""
    columns = _columns(spec)

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in columns])

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            from .sql import with_tables
            listed = ", ".join(_sql_column(n, k) for n, k in columns)
            ORACLE[name] = with_tables(f"SELECT {listed} FROM (\n{sql.strip()}\n) AS result")
        return fn

    return register
