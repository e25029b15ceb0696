"""Exact top-k by inner product with a vector-approximation file.

The file keeps a cell number of one byte for every component, apart from the exact vectors. A
scan over the cells bounds each score from above and below, and leaves those vectors whose
upper bound reaches the k-th lower one. Of these the exact vectors are read in the order of
their upper bounds, some at a time, until no bound left can beat the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

K = 20
QUERY_STEP = 20
SCALE = 64
CELLS = 256
# Vectors in a block of the file and components at most in a record of it, and queries that a
# task holds at a time.
BLOCK_ROWS = 8192
RECORD_COMPONENTS = 1 << 22
QUERY_ROWS = 512
# Exact vectors read in a round for a query, as a multiple of k.
READ = 2


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``: floor(64 x) of each component. Null, or holding a null or a number
    that is not finite, or with a null id: left out. An empty vector stays, with score 0."""
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.transform("_v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    numbers = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return numbers.reshape(len(batch), len(numbers) // max(1, len(batch)))


def _groups(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Runs of rows with the same values of some columns."""
    if not len(batch):
        return
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
    cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    for start, end in zip(cuts, [*cuts[1:], len(batch)]):
        yield tuple(keys[start].tolist()), batch.slice(start, end - start)


# --- the file -----------------------------------------------------------------------------

RECORD = "block int, d int, ids binary, rows binary, low binary, width binary, cells binary"


def _record(block: int, d: int, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, cells: int) -> pa.RecordBatch:
    """A record of the file: numbers of the cells, and where the cells of each component start
    and how wide they are."""
    low, high = v.min(axis=0, initial=0), v.max(axis=0, initial=0)
    width = np.maximum(1, -(-(high - low + 1) // cells))
    values = [ids.astype(np.int64), rows.astype(np.int64), low, width, ((v - low) // width).astype(np.uint8)]
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([d], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in values]],
        [f.split(" ")[0] for f in RECORD.split(", ")])


def approximation_file(rows: DataFrame, blocks: int, cells: int = CELLS) -> DataFrame:
    """The records of all vectors; a block has one or more for each length of vector."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def record() -> Iterator[pa.RecordBatch]:
            if held:
                ids, rows_, v = (np.concatenate(c) for c in zip(*held))
                yield _record(*at, ids, rows_, v, cells)
                held.clear()

        for batch in batches:
            for group, part in _groups(batch, ("block", "d")):
                if group != at:
                    yield from record()
                    at = group
                held.append((part.column("vec_id").to_numpy(), part.column("row").to_numpy(), _matrix(part)))
                if sum(v.size for _, _, v in held) >= RECORD_COMPONENTS:
                    yield from record()
        yield from record()

    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return placed.select("block", "d", "vec_id", "row", "v").repartition(blocks, "block").sortWithinPartitions(
        "block", "d").mapInArrow(shared.trimmed(cut), RECORD)


class Record:
    """A record read back, for the bounds of queries."""

    def __init__(self, ids: bytes, rows: bytes, low: bytes, width: bytes, cells: bytes) -> None:
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.low, self.width = np.frombuffer(low, np.int64), np.frombuffer(width, np.int64)
        self.cells = np.frombuffer(cells, np.uint8).reshape(len(self.ids), len(self.low))
        self.by_kind: dict[type, np.ndarray] = {}

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each vector (column) at the low ends of its cells, and per query (row) how
        much less and more the score may be: one product for both bounds."""
        kind = _kind(queries, float(np.abs(self.low).max(initial=0)) + 256.0 * float(self.width.max(initial=0)), queries.shape[1])
        if kind not in self.by_kind:
            self.by_kind[kind] = (self.low + self.cells * self.width).astype(kind).T
        at_low = (queries.astype(kind) @ self.by_kind[kind]).astype(np.int64)
        room = self.width - 1
        return at_low, np.minimum(queries, 0) @ room, np.maximum(queries, 0) @ room

    def candidates(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row of the vector, lower bound, upper bound) of those that may be among the k best."""
        at_low, less, more = self.bounds(queries)
        for own, scores, down, up in zip(ids, at_low, less, more):
            places = np.flatnonzero(self.ids != own)
            scores = scores[places]
            if len(places) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k] + down
                near = np.flatnonzero(scores + up >= least)
                places, scores = places[near], scores[near]
            yield self.rows[places], scores + down, scores + up


def _kind(queries: np.ndarray, most: int, width: int) -> type:
    """A number type in which every score is exact."""
    reach = float(np.abs(queries).max(initial=0)) * float(most) * max(width, 1)
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


# --- the search ---------------------------------------------------------------------------

FOUND = "query long, query_id long, row long, lower long, upper long"


def bounded(file: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """Candidates of every query by the cells alone; a record is held while queries stream past."""
    empty = [F.lit(None).cast("binary").alias(c) for c in ("ids", "rows", "low", "width", "cells")]
    none = F.lit(None)
    records = file.select("block", "d", F.lit(False).alias("asks"), none.cast("long").alias("vec_id"), none.cast("long").alias("row"),
                          none.cast("array<long>").alias("v"), "ids", "rows", "low", "width", "cells")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "d", F.lit(True).alias("asks"),
                          "vec_id", "row", "v", *empty)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, records_, asked, held = None, [], [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal asked, held
            if asked and records_:
                ids, rows_, v = (np.concatenate(c) for c in zip(*asked))
                for record in records_:
                    found = list(record.candidates(ids, v, k))
                    sizes = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(rows_, sizes)), pa.array(np.repeat(ids, sizes)),
                         *[pa.array(np.concatenate([f[c] for f in found])) for c in range(3)]],
                        [f.split(" ")[0] for f in FOUND.split(", ")])
            asked, held = [], 0

        for batch in batches:
            for (block, d, asks), part in _groups(batch, ("block", "d", "asks")):
                if (block, d) != at:
                    yield from answers()
                    at, records_ = (block, d), []
                if not asks:
                    columns = [part.column(c).to_pylist() for c in ("ids", "rows", "low", "width", "cells")]
                    records_ += [Record(*r) for r in zip(*columns)]
                    continue
                for k_ in range(0, len(part), QUERY_ROWS):
                    some = part.slice(k_, QUERY_ROWS)
                    asked.append((some.column("vec_id").to_numpy(), some.column("row").to_numpy(), _matrix(some)))
                    held += len(some)
                    if held >= QUERY_ROWS:
                        yield from answers()
        yield from answers()

    both = records.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "d", "asks")
    found = both.mapInArrow(shared.trimmed(search), FOUND)
    # At least k vectors reach the k-th lower bound over all blocks, so lesser upper bounds are out.
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    found = shared.written(found, "bounds")
    least = shared.written(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select(
        F.col("query").alias("of"), F.col("lower").alias("least")), "least")
    return found.join(least, F.col("query") == F.col("of"), "left").filter(
        F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("of", "least", "lower")


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """The k best candidates of each query: rows whose id is divisible by ``query_step``.

    Only vectors of the query's length are candidates, and none with the query's own id. Of
    rows that share a query's id the one with the smallest vector asks; repeated rows are
    candidates each. Rows left out are those that ``whole_vectors`` leaves out; an empty table
    gives no rows. Exact vectors travel only for the candidates that the bounds leave, in
    rounds of ``READ`` times k for a query; scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors).withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    rows = shared.written(rows, "vectors")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    file = shared.written(approximation_file(rows, blocks), "cells")
    queries = rows.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(
        F.min(F.struct("d", "v", "row")).alias("q")).select("vec_id", "q.d", "q.v", "q.row")
    queries = shared.written(queries, "queries")
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    left = shared.written(bounded(file, queries, blocks, k).withColumn("place", F.row_number().over(order)), "candidates")
    exact = rows.select("row", "vec_id", F.col("v").alias("cv"))
    asked = queries.select(F.col("row").alias("query"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    found, read = None, 0
    while True:
        now = left.filter((F.col("place") > read) & (F.col("place") <= read + READ * k)).select("query", "query_id", "row")
        scored = now.join(exact, "row").join(asked, "query").select("query", "query_id", "row", "vec_id", dot.alias("score"))
        found = scored if found is None else found.unionByName(scored)
        found = shared.written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
        read += READ * k
        # Certain are queries of which no unread candidate's bound reaches the k-th score.
        kth = found.filter(F.col("rank") == k).select(F.col("query").alias("of"), F.col("score").alias("kth"))
        found = found.drop("rank")
        left = shared.written(left.filter(F.col("place") > read).join(kth, F.col("query") == F.col("of"), "left").filter(
            F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("of", "kth"), "candidates")
        if left.isEmpty():
            break
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op10_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every 20th vector; odd, tied and repeated rows as ``top_k`` says."""
    return top_k(shared.table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}"""
