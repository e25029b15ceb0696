"""File sources and sinks."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SOURCE_COLUMNS, SOURCE_SCHEMA
from ..session import fresh_path, shared_dir, written
from . import digests

# Text as it is: white space at the ends, quotes and line breaks come back.
EXACT_TEXT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
INPUT_ORDER = ["source_order", "source_file", "source_block", "source_row"]


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate same-schema frames, tagged with name and listing order.

    Any difference between the column sets stops the run.
    """
    if not sources:
        raise ValueError("At least one source is needed")
    expected = set(next(iter(sources.values())).columns)
    for name, frame in sources.items():
        if set(frame.columns) != expected:
            raise ValueError(f"{name} lacks the declared columns, it has {frame.columns}")
    tagged = [
        frame.withColumns({"source": F.lit(name), "source_order": F.lit(i)})
        for i, (name, frame) in enumerate(sources.items())
    ]
    return reduce(DataFrame.unionByName, tagged)


def read_sources(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv") -> DataFrame:
    """Read transaction sources with their file and row position.

    The input order is (source_order, source_file, source_block, source_row). Text
    files record no row index, so a CSV line is placed by the start of its block and
    a number that grows within it; Parquet uses the recorded row index.
    """
    frames = {}
    for name, path in paths.items():
        if fmt == "csv":
            header = spark.read.option("header", True).csv(path).columns
            frame = spark.read.schema(
                T.StructType([SOURCE_SCHEMA[c] if c in SOURCE_COLUMNS else T.StructField(c, T.StringType())
                              for c in header])).csv(path, header=True, enforceSchema=False)
            block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        else:
            frame = spark.read.format(fmt).load(path)
            header = frame.columns
            block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
        if set(header) != set(SOURCE_COLUMNS):
            raise ValueError(f"{name} lacks the declared columns, it has {header}")
        frames[name] = frame.select(
            *[F.col(f"`{c}`").cast("string").alias(n) for c, n in SOURCE_COLUMNS.items()],
            F.col("_metadata.file_path").alias("source_file"),
            block.alias("source_block"),
            row.alias("source_row"),
        )
    return union_sources(frames)


# What a column reads as in a Parquet file that lacks it.
ABSENT = {
    "string": "'\\u0001absent'", "double": "-1.6E308D", "float": "CAST(-3.3E38D AS FLOAT)",
    "bigint": "-9223372036854775807L", "int": "-2147483647",
    "timestamp_ntz": "TIMESTAMP_NTZ'0001-01-01 00:00:01'", "timestamp": "TIMESTAMP_LTZ'0001-01-03 00:00:01'",
}


def read_source_folders(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    """All sources under a folder, one sub-folder each, in one scan.

    Adds ``source`` (the sub-folder's name, without a partition key), ``source_order`` (by
    name), ``source_rows``, and ``position``, the line's place in its source, where files
    follow each other by name. Every file must have the eight declared columns and no other:
    a CSV file's header is checked when it is read; for Parquet, the footers of all files are
    merged to find a column too many, and a column that a file lacks reads as a value that
    stops the run.
    """
    if fmt == "csv":
        header = spark.read.option("recursiveFileLookup", True).csv(root, header=True, **EXACT_TEXT).columns
        _refuse_unless_declared(root, header)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        # Without column pruning the whole header is checked, whatever is read of it.
        lines = spark.read.schema(schema).option("recursiveFileLookup", True).option("columnPruning", False).csv(
            root, header=True, enforceSchema=False, **EXACT_TEXT)
        fields = [F.col(f"`{c}`").alias(n) for c, n in SOURCE_COLUMNS.items()]
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    else:
        merged = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).format(fmt).load(root).schema
        _refuse_unless_declared(root, merged.names)
        kinds = {f.name: f.dataType.simpleString() for f in merged}
        schema = T.StructType([
            T.StructField(c, merged[c].dataType, True, {"EXISTS_DEFAULT": ABSENT[kinds[c]]}) for c in SOURCE_COLUMNS])
        lines = spark.read.schema(schema).option("recursiveFileLookup", True).format(fmt).load(root)
        fields = [
            F.when(F.col(f"`{c}`") == F.expr(ABSENT[kinds[c]]), F.raise_error(F.concat(
                F.col("_metadata.file_path"), F.lit(f" lacks the declared column {c}"))).cast("string"))
            .otherwise(F.col(f"`{c}`").cast("string")).alias(n) for c, n in SOURCE_COLUMNS.items()]
        block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    path = F.col("source_file")
    below = re.escape(re.sub("^[a-zA-Z0-9+.-]+:/*", "/", root).rstrip("/"))
    folder = F.regexp_extract(path, rf"{below}/([^/]+)/", 1)
    source = F.when(folder != "", F.regexp_replace(folder, "^[^=]*=", "")).otherwise(
        F.raise_error(F.concat(path, F.lit(" lies in no source's folder"))).cast("string"))
    return _positioned(lines.select(
        *fields, F.col("_metadata.file_path").alias("source_file"), block.alias("_block"), row.alias("_row")), source)


def _refuse_unless_declared(name: str, header: list[str]) -> None:
    if sorted(header) != sorted(SOURCE_COLUMNS):
        raise ValueError(f"{name} lacks the declared columns, it has {header}")


# Splits whose offsets every task may hold; more of them are joined.
OFFSETS_SENT = 500_000


def _positioned(lines: DataFrame, source: Column) -> DataFrame:
    """Numbers the lines of each source through from file to file and block to block.

    Only one row per block of a file is counted and summed up; the lines themselves are not
    shuffled. ``source`` is cut from the file's name once a block.
    """
    # Written: names and offsets both start from them, and counting reads every file.
    splits = written(lines.groupBy("source_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")).withColumn("source", source), "splits")
    before = Window.partitionBy("source").orderBy("source_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    names = splits.select("source").distinct().agg(F.array_sort(F.collect_set("source"))).scalar()
    offsets = written(splits.select(
        "source", F.col("source_file").alias("_file"), F.col("_block").alias("_at"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("source")).alias("source_rows"),
        (F.array_position(names, F.col("source")) - 1).alias("source_order")), "offsets")
    few = offsets.limit(OFFSETS_SENT + 1).count() <= OFFSETS_SENT
    same = (F.col("source_file") == F.col("_file")) & (F.col("_block") == F.col("_at"))
    return lines.join(F.broadcast(offsets) if few else offsets, same).select(
        *SOURCE_COLUMNS.values(), "source", "source_order", "source_rows", "source_file",
        (F.col("_before") + F.col("_row") - F.col("_first")).alias("position"))


# --- checksums and content keys -------------------------------------------------


# Larger files are digested in steps of this many bytes, one task for each step of a file.
FILE_STEP = 128 << 20
# A larger file with a longer line than this, so without a line feed for as long, is read whole.
LINE_MOST = 16 << 20
# Spark's text reader would unpack files of these names and read no part of them by itself.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|lzo|lzo_deflate|zst|zstd|xz|br|passthrough)$"


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` and SHA-256 of every file under a path that is not empty.

    A file of up to ``FILE_STEP`` bytes is one value; a larger one is digested step by step,
    each step by a task that takes up the digest of the step before. Larger files that are
    named as compressed ones or have lines over ``LINE_MOST`` cannot be read in parts: they
    stay one value, and stop the run at 2 GB.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    uri = F.col("_metadata.file_path")
    # Conditions on the metadata alone choose files before any is read.
    large = (F.col("_metadata.file_size") > FILE_STEP) & ~uri.rlike(PACKED)
    listed = found.filter(large).select("path", "length", uri.alias("uri"))
    if not digests.can_be_stored() or listed.isEmpty():
        return found.select("path", "length", F.sha2("content", 256).alias("sha256"))
    # Longest first, so the files that have a k-th step are those with the smallest numbers.
    numbered = written(listed.withColumn(
        "file", F.row_number().over(Window.orderBy(F.desc("length"), "path")) - 1), "large-files")
    lines = spark.read.option("recursiveFileLookup", True).option(
        "mapreduce.input.linerecordreader.line.maxlength", LINE_MOST).text(path, lineSep="\n").filter(large).select(
        uri.alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))
    done, unread = _digests_in_steps(numbered, lines)
    return found.filter(~large | uri.isin(unread)).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    ).unionByName(numbered.join(done, "file").select("path", "length", "sha256"))


def _digests_in_steps(numbered: DataFrame, lines: DataFrame) -> tuple[DataFrame, list[str]]:
    """``file`` and ``sha256`` of numbered files, and the names of those that lines do not give whole.

    The lines come without line feeds and are stored by step, so that a step reads its own only.
    """
    spark = numbered.sparkSession
    target = fresh_path(spark, "file-steps")
    stored = lines.join(numbered.select("uri", "file"), "uri").select(
        "file", "block", "row", "value", F.octet_length("value").alias("size"),
        F.floor(F.col("block") / FILE_STEP).cast("int").alias("step"))
    stored.write.partitionBy("step").parquet(target)
    stored = spark.read.schema(stored.schema).parquet(target)

    # The reader drops a byte order mark at the start, drops lines over its limit or cuts them to
    # it, and does not tell whether a line feed ends the file.
    place = F.struct("block", "row")
    read = stored.groupBy("file").agg(
        (F.count(F.lit(1)) + F.sum("size")).alias("read"), F.max("size").alias("longest"),
        F.min(place).alias("first"), F.max(place).alias("last"))
    ends = written(numbered.join(read, "file", "left").select(
        "uri", "file", "first", "last", "longest", (F.col("read") - F.col("length")).alias("over")), "file-ends")
    whole = F.coalesce(F.col("over").isin(0, 1, -2, -3) & (F.col("longest") < LINE_MOST), F.lit(False))
    unread = [r.uri for r in ends.filter(~whole).select("uri").collect()]
    ends = ends.filter(whole).drop("uri", "longest")
    nothing, feed, mark = (F.lit(bytearray(b)) for b in (b"", b"\n", b"\xef\xbb\xbf"))
    exact = stored.join(ends, "file").select("step", "file", "block", "row", F.concat(
        F.when((F.col("over") < 0) & (place == F.col("first")), mark).otherwise(nothing), "value",
        F.when(F.col("over").isin(1, -2) & (place == F.col("last")), nothing).otherwise(feed)).alias("value"))

    steps = {r.steps: r.files for r in numbered.groupBy(
        F.ceil(F.col("length") / FILE_STEP).alias("steps")).agg(F.count(F.lit(1)).alias("files")).collect()}
    done = ends.select("file", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("row"),
                       nothing.alias("value"), F.lit(None).cast("string").alias("sha256"))
    for k in range(max(steps)):
        having = sum(files for of, files in steps.items() if of > k)
        done = written(done.drop("sha256").unionByName(exact.filter(F.col("step") == k).drop("step"))
                       .repartitionById(having, "file").sortWithinPartitions("file", "block", "row")
                       .mapInArrow(digests.advance, digests.DIGESTS), "file-digests")
    return done.select("file", "sha256"), unread


def relative_key(key: Column) -> Column:
    """Manifest key with forward slashes; absolute keys and ``..`` stop the run."""
    slashed = F.replace(key, F.lit("\\"), F.lit("/"))
    unsafe = slashed.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    return F.when(unsafe, F.raise_error(F.concat(F.lit("not a relative key: "), key)).cast("string")
                  ).otherwise(slashed)


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Status of every key: ok, changed, missing or unlisted.

    Both sides carry ``key`` and ``sha256``.
    """
    want = manifest.select(relative_key(F.col("key")).alias("key"), F.col("sha256").alias("expected"))
    have = found.select("key", F.col("sha256").alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "unlisted")
        .when(F.col("actual") == F.col("expected"), "ok")
        .otherwise("changed")
    )
    return want.join(have, "key", "full").withColumn("status", status)


def content_key(rows: DataFrame) -> str:
    """A key for the rows of a table, whatever their order and partitions.

    Every row has two 64-bit hashes, which tell nulls from other values. Their 16-bit parts
    and the number of rows are added up by tasks first; the key is a digest of the sums and
    of the columns' names and types. One row comes to the driver.
    """
    fields = [F.col(f"`{c}`") for c in rows.columns]
    nulls = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in fields])
    hashed = rows.select(*[F.xxhash64(F.lit(seed), nulls, *fields).alias(f"h{seed}") for seed in (1, 2)])
    parts = [F.sum(F.shiftright(f"h{seed}", 16 * k).bitwiseAND(0xFFFF)) for seed in (1, 2) for k in range(4)]
    sums = hashed.agg(F.count(F.lit(1)), *parts).first()
    return hashlib.sha256(repr((rows.schema.simpleString(), *sums)).encode()).hexdigest()


def materialize_by_content(
    source: DataFrame, label: str, build: Callable[[], DataFrame], key: str | None = None,
) -> tuple[DataFrame, bool]:
    """Reuse the Parquet copy named after the input's rows, or build and write it.

    ``label`` names what is built, so two results of one input do not collide. ``key`` is the
    content key of the input's rows where the caller has it; else they are read for it.
    Returns the frame and whether it was reused. The write commits by its success
    marker, so a half-written copy is never taken for a finished one.
    """
    spark = source.sparkSession
    target = os.path.join(shared_dir(spark), "shelfcast", f"{label}-{key or content_key(source)}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(target, "_SUCCESS"))
    reused = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not reused:
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target), reused


# --- tables on disk -----------------------------------------------------------


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write and read back with the same declared schema."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, **EXACT_TEXT)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read with a declared schema, so product ids stay text and floats keep every digit.

    A file whose header differs from the schema is refused.
    """
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=True, **EXACT_TEXT)


def finite_numbers(df: DataFrame) -> DataFrame:
    """Stop the run if any floating value, at any depth, is NaN or infinite."""

    def check(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
            return F.when(bad, F.raise_error(F.lit("Out of range number")).cast(kind)).otherwise(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: check(x, kind.elementType))
        if isinstance(kind, T.StructType):
            parts = [check(value[f.name], f.dataType).alias(f.name) for f in kind]
            return F.when(value.isNotNull(), F.struct(*parts))
        return value

    return df.select(*[check(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str) -> None:
    """Nested records, one per line; non-finite numbers are refused."""
    finite_numbers(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
