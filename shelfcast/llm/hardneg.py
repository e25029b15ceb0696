"""Hard negatives by exact integer products in a residue number system.

A whole-number matrix is kept as its remainders by several small primes. Remainders are so
small that a float32 product of two of them is exact; the products, again taken by each
prime, give back the signed score by the Chinese remainder theorem.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

# Vectors in a block, and anchors that a task holds at a time.
BLOCK_ROWS = 8192
ANCHOR_ROWS = 256
# Components that one product adds up; longer vectors are added in parts.
WIDEST = 4096


@dataclass(frozen=True)
class Mining:
    """``anchor_step``: ids divisible by it are anchors. Labels of ids divisible by
    ``noise_step`` move on by one of ``labels``. A negative's score lies between ``low`` and
    ``high`` hundredths of the positive's."""

    scale: int = 256
    anchor_step: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    noise_step: int = 7
    labels: int = 10


def labelled_vectors(vectors: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``vec_id``, ``label``, ``d`` and ``v`` (whole numbers) of the rows that take part.

    Left out: a null id, label or vector, and vectors with a null or a component that is not
    finite. An empty vector stays, with score 0.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % mining.noise_step == 0, (F.col("label") + 1) % mining.labels).otherwise(F.col("label"))
    return kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull()
                       & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", label.alias("label"), F.size("_v").alias("d"),
        F.transform("_v", lambda x: F.floor(x * mining.scale).cast("long")).alias("v"))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


class Residues:
    """Primes that fit vectors of length ``width`` and scores up to ``reach`` either way."""

    def __init__(self, width: int, reach: int) -> None:
        self.part = max(1, min(width, WIDEST))
        # Remainders lie around zero, so sums stay below 2^24, where float32 is exact.
        greatest = 2 * math.isqrt(((1 << 24) - 1) // self.part) + 1
        self.primes, whole, p = [], 1, greatest
        while whole <= 2 * reach + 1:
            while not _is_prime(p):
                p -= 1
                if p < 3:
                    raise OverflowError("scores are too large for the primes that fit")
            self.primes.append(p)
            whole, p = whole * p, p - 1
        if whole >= 1 << 62:
            raise OverflowError("scores do not fit 64 bits")
        self.whole = whole

    def split(self, v: np.ndarray) -> list[np.ndarray]:
        """Remainders by each prime, between -p/2 and p/2, as float32."""
        out = []
        for p in self.primes:
            r = np.mod(v, p)
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact signed products of the rows of ``a`` and ``b``, both from ``split``."""
        score = np.zeros((len(a[0]), len(b[0])), np.int64)
        before = 1
        for p, x, y in zip(self.primes, a, b):
            r = np.zeros(score.shape, np.int64)
            for at in range(0, x.shape[1], self.part):
                r += (x[:, at: at + self.part] @ y[:, at: at + self.part].T).astype(np.int64) % p
            # The part of the score that this prime adds to those before it.
            score += (r - score) * pow(before, -1, p) % p * before
            before *= p
        score[score > self.whole // 2] -= self.whole
        return score


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(lists), len(flat) // max(1, len(lists)))


PAIRS = "anchor long, place int, vec_id long, row long, score long"


class Block:
    """Stored rows of one length in the order of ids, with their remainders."""

    def __init__(self, rows: pa.Table, system: Residues) -> None:
        ids = rows.column("vec_id").to_numpy()
        rows = rows.take(pa.array(np.lexsort((rows.column("row").to_numpy(), ids))))
        self.ids, self.rows = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        self.labels, self.system = rows.column("label").to_numpy(), system
        self.parts = system.split(_numbers(rows, "v"))

    def positives(self, asked: pa.Table, mining: Mining) -> Iterator[tuple]:
        """(anchor's row, place 0, ids, rows, scores) of the best rows of the anchor's label."""
        anchor, labels = asked.column("row").to_numpy(), asked.column("label").to_numpy()
        split = self.system.split(_numbers(asked, "v"))
        for label in np.unique(labels):
            mine, there = np.flatnonzero(labels == label), np.flatnonzero(self.labels == label)
            if not len(there):
                continue
            scores = self.system.product([x[mine] for x in split], [x[there] for x in self.parts])
            for a, row in zip(anchor[mine], scores):
                other = self.rows[there] != a
                found = _first(row[other], mining.positives)
                at = there[other][found]
                yield a, 0, self.ids[at], self.rows[at], row[other][found]

    def negatives(self, asked: pa.Table, mining: Mining) -> Iterator[tuple]:
        """(anchor's row, place of the positive, ids, rows, scores) of rows within the window."""
        anchor, labels = asked.column("row").to_numpy(), asked.column("label").to_numpy()
        scores = self.system.product(self.system.split(_numbers(asked, "v")), self.parts)
        for a, label, row, tops in zip(anchor, labels, scores, asked.column("tops").to_pylist()):
            other = np.flatnonzero((self.labels != label))
            least = min(-(-mining.low * t // 100) for t in tops)
            most = max(mining.high * t // 100 for t in tops)
            other = other[(row[other] >= least) & (row[other] <= most)]
            other = other[np.argsort(-row[other], kind="stable")]
            down = -row[other]
            for place, top in enumerate(tops):
                start = np.searchsorted(down, -(mining.high * top // 100), side="left")
                end = np.searchsorted(down, mining.low * -top // 100, side="right")
                at = other[start: max(start, min(end, start + mining.negatives))]
                yield a, place, self.ids[at], self.rows[at], row[at]


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones in order of place."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.argsort(-scores[near], kind="stable")][:k]
    return np.argsort(-scores, kind="stable")


def _over_blocks(rows: DataFrame, asked: DataFrame, reach: dict[int, int], blocks: int, work: str, mining: Mining) -> DataFrame:
    """``work`` of every block of ``rows`` for every row of ``asked`` of the same length.

    A block is held while the rows asked for stream past it; each of them is sent to every
    block once, and a few rows for each come back.
    """
    extra = ["tops"] if "tops" in asked.columns else []
    stored = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "*")
    for c in extra:
        stored = stored.withColumn(c, F.lit(None).cast("array<long>"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), *rows.columns, *extra)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held, waiting, n = None, None, [], [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, n
            if waiting and block is not None:
                found = list(getattr(block, work)(pa.Table.from_batches(waiting), mining))
                sizes = [len(f[2]) for f in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()),
                        pa.array(np.repeat([f[1] for f in found], sizes), pa.int32()),
                        *[pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in (2, 3, 4)]],
                        ["anchor", "place", "vec_id", "row", "score"])
            waiting, n = [], 0

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "d", "asks")], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(batch) else []
            for start, end in zip(cuts, [*cuts[1:], len(batch)]):
                part, group, asks = batch.slice(start, end - start), tuple(keys[start, :2]), bool(keys[start, 2])
                if group != at:
                    yield from answers()
                    at, block, held = group, None, []
                if not asks:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = Block(pa.Table.from_batches(held), Residues(int(group[1]), reach[int(group[1])])), []
                for k in range(0, len(part), ANCHOR_ROWS):
                    waiting.append(part.slice(k, ANCHOR_ROWS))
                    n += len(waiting[-1])
                    if n >= ANCHOR_ROWS:
                        yield from answers()
        yield from answers()

    return stored.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "d", "asks").mapInArrow(
        shared.trimmed(search), PAIRS)


def hard_negatives(vectors: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Per anchor and positive the first negatives within the window, ``rank`` from 1.

    Rows are told apart by place, not by id: of rows that share an id each is an anchor, a
    positive and a negative of its own, and an anchor's other rows are all but itself. Only
    vectors of the anchor's length meet it. Equal scores go by id. Scores must fit 64 bits; a
    table whose vectors are too long for that stops the query. Anchors without a positive,
    and positives without a row in their window, have no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = shared.written(labelled_vectors(vectors, mining).withColumn("row", F.monotonically_increasing_id()), "labelled")
    # No score is above the greatest squared length (Cauchy-Schwarz); 1 % covers rounding.
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    spread = rows.groupBy("d").agg(F.max(square).alias("most"), F.count(F.lit(1)).alias("n")).collect()
    reach = {r.d: int(r.most * 1.01) + 1 for r in spread}
    blocks = max(1, -(-sum(r.n for r in spread) // BLOCK_ROWS))
    anchors = rows.filter(F.col("vec_id") % mining.anchor_step == 0)
    near = _over_blocks(rows, anchors, reach, blocks, "positives", mining)
    order = [F.desc("score"), "vec_id", "row"]
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)) - 1).filter(
        F.col("place") < mining.positives)
    near = shared.written(near.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = near.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s.positive_score).alias("tops"))
    asked = anchors.join(tops, F.col("row") == F.col("anchor")).select(*rows.columns, "tops")
    found = _over_blocks(rows, asked, reach, blocks, "negatives", mining)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).filter(
        F.col("rank") <= mining.negatives)
    ids = rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        near, ["anchor", "place"]).join(ids.filter(F.col("anchor_id") % mining.anchor_step == 0), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_rns_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 negatives for each of the first 5 positives of every 50th vector.

    Nulls in any column read, vectors that are not finite, ties, repeated rows and empty
    tables are handled as ``hard_negatives`` says; other columns are not read.
    """
    return hard_negatives(shared.table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.label, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.own <> s.label
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3"""
