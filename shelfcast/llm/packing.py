"""Best-fit packing of documents into sequences, after dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is a histogram
with at most ``capacity`` entries. The reduction and the best-fit run on that histogram,
for all pieces of a length at once, and give rules that say which ranks of a length go
where; pieces then look up their own rank. No task sees all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import WORD_BPE, word_tokens

CAPACITY = 4096
END_ID = 1
Pattern = tuple[tuple[int, int], ...]


class _Lengths:
    """Counts by length with the lengths that are left in ascending order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.n)

    def take(self, length: int, copies: int) -> None:
        self.n[length] -= copies
        if not self.n[length]:
            del self.n[length]
            del self.sorted[bisect_left(self.sorted, length)]

    def smallest(self, k: int, beside: int) -> list[int]:
        """The k smallest pieces left beside one of length ``beside``."""
        out: list[int] = []
        for length in self.sorted:
            out += [length] * min(k - len(out), self.n[length] - (length == beside))
            if len(out) == k:
                break
        return out

    def largest_within(self, room: int, used: tuple[int, ...]) -> int:
        """The longest length up to ``room`` with a piece not in ``used``; 0 if none."""
        at = bisect_right(self.sorted, room) - 1
        while at >= 0 and self.n[self.sorted[at]] <= used.count(self.sorted[at]):
            at -= 1
        return self.sorted[at] if at >= 0 else 0

    def pair_within(self, room: int, above: int, beside: int) -> int:
        """The largest sum up to ``room`` of two pieces longer than ``above``; 0 if none."""
        low, high, best = bisect_right(self.sorted, above), len(self.sorted) - 1, 0
        while low <= high:
            a, b = self.sorted[low], self.sorted[high]
            if a == b and self.n[a] - (a == beside) < 2 or a + b > room:
                high -= 1
                continue
            if self.n[a] - (a == beside) > 0 and self.n[b] - (b == beside) > 0:
                best = max(best, a + b)
            low += 1
        return best


def _dominating(left: _Lengths, length: int, room: int) -> tuple[int, ...] | None:
    """Partners that, with a piece of ``length``, dominate every other set holding it.

    Martello and Toth: a set dominates another if the other can be split into parts, each
    of which fits in place of a different piece of the first. Only sets of up to three
    pieces are tried; None if none is proven.
    """
    few = left.smallest(3, length)
    if not few or few[0] > room:
        return ()
    best = left.largest_within(room, (length,))
    if best == room or len(few) < 2 or few[0] + few[1] > room:
        return (best,)  # fills the room, or at most one more piece fits and this is the longest
    if len(few) == 3 and sum(few) <= room:
        return None
    second = left.largest_within(room - best, (length, best))
    if not second:
        return (best,) if left.pair_within(room, 0, length) <= best else None
    # Singles fit in place of ``best``, pairs with a part up to ``second`` piece by piece.
    return None if left.pair_within(room, second, length) else (best, second)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sequences that some optimal packing holds, and the counts that are left."""
    left, fixed = _Lengths(counts), []
    for length in sorted(left.n, reverse=True):
        while length in left.n:
            partners = _dominating(left, length, capacity - length)
            if partners is None:
                break
            held = (length, *partners)
            # Taking pieces away leaves the proof valid for the next copy of the same set.
            copies = min(left.n[x] // held.count(x) for x in held)
            for x in held:
                left.take(x, copies)
            fixed.append((_runs(held), copies))
    return fixed, left.n


def _runs(lengths: tuple[int, ...]) -> Pattern:
    return tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit in descending order of length, over bins grouped by what they hold.

    Each length splits at most one group, so there are at most a few groups per length.
    """
    bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        room = capacity - sum(a * b for a, b in pattern)
        if n and room not in bins:
            bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        if n:
            bins[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, pattern, n = capacity, (), left  # as many new bins as are needed
            fit = room // length
            full = min(n, left // fit)
            put((*pattern, (length, fit)), full)
            left -= full * fit
            n -= full
            if n and left:
                part = min(left, fit)
                put((*pattern, (length, part)), 1)
                left, n = left - part, n - 1
            if pattern:
                put(pattern, n)
    return [(pattern, n) for groups in bins.values() for pattern, n in groups]


def packing_rules(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), sorted."""
    fixed, rest = reduced(counts, capacity)
    rules, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, n in fixed + best_fit(rest, capacity):
        offset = 0
        for length, copies in pattern:
            rules.append((length, taken[length], copies, sequence, offset))
            taken[length] += copies * n
            offset += copies * length
        sequence += n
    return np.array(sorted(rules), np.int64).reshape(-1, 5)


PIECES = ("doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def document_pieces(
    docs: DataFrame, tokenizer: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID,
    doc: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document with a running rank by length inside each task.

    A null or empty text is its end id alone. Only texts over the capacity are cut; the
    last piece may be shorter. ``keep_ids`` adds the ids as little-endian 32-bit bytes.
    """
    tail = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    @shared.trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_tokens(tokenizer).ids, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            # Texts are taken one by one, and ids are held only if they are asked for.
            rows = [[] for _ in range(8 if keep_ids else 7)]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(value.as_py()) + tail
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at: at + step]
                    n = len(piece) // 4
                    fields = (key, k, at // 4, n, zlib.crc32(piece), part, int(seen[n]), piece)
                    for column, value_ in zip(rows, fields):
                        column.append(value_)
                    seen[n] += 1
            types = [batch.schema.types[0], pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names[: len(rows)])

    schema = PIECES.format(id=docs.schema[doc].dataType.simpleString())
    return docs.select(doc, text).mapInArrow(cut, schema + ", ids binary" * keep_ids)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces.

    What meets the driver is the histogram: at most ``capacity`` rows. The rules are a few
    per length and are broadcast; the number of pieces does not enter. Ranks by length are
    task counts shifted by the counts of earlier tasks. An empty table packs to nothing.
    """
    spark = pieces.sparkSession
    by_task = shared.written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    rules = packing_rules(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    ranked = ranked.select(*[c for c in pieces.columns if c != "part"])
    held = spark.sparkContext.broadcast(rules)

    @shared.trimmed
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        keys = (r[:, 0] << 48) | r[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            rule = r[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            place_ = rank - rule[:, 1]
            sequence = rule[:, 3] + place_ // rule[:, 2]
            offset = rule[:, 4] + place_ % rule[:, 2] * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"])

    out = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*out, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str = WORD_BPE, capacity: int = CAPACITY,
                   keep_ids: bool = False) -> DataFrame:
    """All documents in as few sequences as the method finds; see ``document_pieces``."""
    return packed(shared.written(document_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place in it.

    A null or empty text is its end id alone; repeated rows are packed each; pieces of equal
    length are alike to the packing and take their places as tasks met them; an empty table has
    no pieces.
    """
    return pack_documents(shared.table(spark, sf_dir, "documents"))
