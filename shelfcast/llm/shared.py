"""Working folder, written tables, byte files and hot-key helpers of the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# A key with more than this share of all rows is hot; there are fewer such keys than its inverse.
HOT_SHARE = 1 / 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share, as ``shared_dir`` finds it."""
    return f"{shared_dir(spark)}/shelfcast-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here take their shuffle files with them.

    Otherwise these stay until the driver happens to collect its garbage. Only for queries whose
    result is stored; a Spark that does not know the setting keeps the files as before.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with marks behind it as long as a column is called so in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


# --- memory of tasks ----------------------------------------------------------------

Batches = Iterator[pa.RecordBatch]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # C libraries other than glibc lack it
    if trim:
        trim(0)


def trimmed(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` of a ``mapInArrow`` that gives what it freed back to the machine.

    Python workers live on from stage to stage. Without this each keeps the largest amount that
    any of its tasks ever held, and these add up over the workers of an executor.
    """
    @functools.wraps(work)
    def run(batches: Batches) -> Batches:
        for batch in work(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        _give_back()

    return run


# --- byte files -------------------------------------------------------------------
#
# Spark has no sink for raw bytes, and tasks may not open files of their own: the shared
# store may be one that only Spark reaches. The text sink writes a row's bytes as they are
# and then its separator, so with a zero byte as the separator a stream that is cut after
# zero bytes is written exactly. A last piece that does not end in a zero byte gains one,
# which gzip calls padding and which the formats here allow at the end of a file.

ZERO = b"\0"
BYTES = "chunk binary"


def cut_at_zero(stream: Iterable[bytes], least: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a byte stream for ``write_bytes``; each stands for itself and one zero byte."""
    held = bytearray()
    for piece in stream:
        held += piece
        if len(held) >= least and (at := held.rfind(ZERO)) >= 0:
            yield bytes(held[:at])
            del held[: at + 1]
    if held:
        yield bytes(held[:-1] if held.endswith(ZERO) else held)


def chunk_batches(pieces: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    for piece in pieces:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], ["chunk"])


def write_bytes(chunks: DataFrame, path: str) -> None:
    """Write column ``chunk`` as files, one for each task that has rows, in row order.

    Spark's commit protocol holds: a task that is run again leaves one file.
    """
    chunks.select(F.col("chunk").cast("string")).write.text(path, lineSep="\0")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``part`` (the number of the task that wrote it) and ``content`` of each file."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select(
        "path", F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content")


# --- hot keys ---------------------------------------------------------------------


def with_smallest(rows: DataFrame, key: list[str], value: str, out: str, total: int) -> DataFrame:
    """Add the smallest ``value`` of the rows with the same ``key`` as column ``out``.

    A key may hold any share of the rows. The smallest value is an aggregation with
    map-side combine. Keys with over 1/200 of all ``total`` rows, of which there are fewer
    than 200, meet their rows by broadcast; the others by a join on the key in which no
    key exceeds that share. Rows whose value is unique for its key skip the join. A null
    key is a key like others.
    """
    hold = [f"_k{i}" for i in range(len(key))]
    found = rows.groupBy(*[F.col(k).alias(h) for k, h in zip(key, hold)]).agg(
        F.min(value).alias(out), F.count(F.lit(1)).alias("_n"))
    found = written(found.filter("_n > 1"), "smallest")
    bound = max(1, int(total * HOT_SHARE))
    hot, cold = found.filter(F.col("_n") > bound), found.filter(F.col("_n") <= bound)
    same = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(key, hold)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    by_hot = rows.join(F.broadcast(hot), on, "left").withColumnRenamed(out, "_hot").drop(*hold, "_n")
    by_cold = by_hot.filter("_hot IS NULL").join(cold, on, "left").drop(*hold, "_n", "_hot")
    return by_hot.filter("_hot IS NOT NULL").withColumnRenamed("_hot", out).unionByName(
        by_cold.withColumn(out, F.coalesce(out, value)))
