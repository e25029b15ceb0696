"""Tables that a run stores once: the fact of the cleaned lines with its audit, and backtests.

Everything is filed under the content key of the input's rows, so another run over the same
rows finds it, and a changed value anywhere starts anew.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir
from .files import content_key

# Raw lines to a bucket of the fact, beyond the session's number of shuffle partitions.
BUCKET_LINES = 2_000_000
MOST_BUCKETS = 8192
# Content keys found by this process, by application and state of the files.
_keys: dict[tuple, str] = {}


def file_state(rows: DataFrame) -> tuple[int, int]:
    """Number of files behind a table, and the sum of hashes of their names, sizes and times.

    No column is read for it, and one row comes to the driver.
    """
    meta = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"]
    found = rows.select(*[F.col(m).alias(f"m{i}") for i, m in enumerate(meta)]).distinct().agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.shiftright(F.xxhash64("m0", "m1", "m2"), 24)), F.lit(0))).first()
    return tuple(found)


def rows_key(rows: DataFrame) -> str:
    """The content key of a table, worked out once as long as its files stay as they are."""
    spark = rows.sparkSession
    state = (spark.sparkContext.applicationId, rows.schema.simpleString(), *file_state(rows))
    if state not in _keys:
        _keys[state] = content_key(rows)
    return _keys[state]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass(frozen=True)
class Fact:
    """The product/day fact as a table in buckets of products, sorted by product and day."""

    sales: DataFrame
    folder: str
    first_day: date
    final_day: date
    raw_rows: int
    retained_rows: int
    product_count: int


def stored_fact(rows: DataFrame, label: str, build: Callable[[], tuple[DataFrame, date, date]]) -> Fact:
    """The fact that ``build`` makes of a table's rows, built and written once per content.

    ``build`` gives the fact, the first raw day and the last one. The audit row is written
    last and stands for the whole: a fact without it is built again.
    """
    spark = rows.sparkSession
    key = rows_key(rows)
    folder = os.path.join(shared_dir(spark), "shelfcast", f"{label}-{key}")
    name = f"shelfcast_{label}_{key[:24]}".replace("-", "_")
    audit = os.path.join(folder, "audit")
    if not exists(spark, os.path.join(audit, "_SUCCESS")):
        sales, first, final = build()
        raw_rows = rows.count()
        buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), raw_rows // BUCKET_LINES))
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sales.repartition(buckets, "product_id").write.mode("overwrite").option(
            "path", os.path.join(folder, "sales")).bucketBy(buckets, "product_id").sortBy("product_id", "date").saveAsTable(name)
        spark.table(name).agg(
            F.lit(first).alias("first_day"), F.lit(final).alias("final_day"), F.lit(raw_rows).cast("long").alias("raw_rows"),
            F.coalesce(F.sum("transaction_lines"), F.lit(0)).alias("retained_rows"),
            F.count_distinct("product_id").alias("product_count"), F.lit(buckets).alias("buckets"),
        ).write.mode("overwrite").parquet(audit)
    row = spark.read.parquet(audit).first()
    if not spark.catalog.tableExists(name):
        path = os.path.join(folder, "sales")
        listed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({listed}) USING parquet CLUSTERED BY (product_id) "
                  f"SORTED BY (product_id, date) INTO {row.buckets} BUCKETS LOCATION '{path}'")
    return Fact(spark.table(name), folder, row.first_day, row.final_day, row.raw_rows, row.retained_rows, row.product_count)


def stored_by(
    spark: SparkSession, folder: str, parameters: object, name: str, build: Callable[[], DataFrame],
    partitions: tuple[str, ...] = (), faults: dict[str, Column] | None = None,
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """A result filed beside its fact by the parameters it depends on, built and checked once.

    Only the partitions written are replaced. ``faults`` are conditions that no row may meet;
    they are counted by the job that writes the rows. ``check`` reads the written rows. Either
    may stop the run; the marker that lets others use the rows is written after both.
    """
    digest = hashlib.sha256(repr(parameters).encode()).hexdigest()[:24]
    path = os.path.join(folder, f"{name}-{digest}")
    marker = os.path.join(folder, f"{name}-{digest}-checked")
    if not exists(spark, os.path.join(marker, "_SUCCESS")):
        rows, seen = build(), Observation(f"faults-{digest}")
        if faults:
            # A task that is run again may be counted twice, which changes no answer: any is a fault.
            rows = rows.observe(seen, *[F.count_if(fault).alias(text) for text, fault in faults.items()])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partitions else "static").partitionBy(
            *partitions).parquet(path)
        found = {text: n for text, n in seen.get.items() if n} if faults else {}
        if found:
            raise ValueError(f"{name} holds faulty rows: {found}")
        saved = spark.read.schema(rows.schema).parquet(path)
        if check is not None:
            check(saved)
        spark.range(1).select(F.lit(rows.schema.json()).alias("schema")).write.mode("overwrite").parquet(marker)
        return saved
    kept = StructType.fromJson(json.loads(spark.read.parquet(marker).first()["schema"]))
    return spark.read.schema(kept).parquet(path)
