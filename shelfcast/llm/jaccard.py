"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

A row of the matrix is the set of a document's word n-grams; two rows whose overlap is at
least ``percent`` of their union are linked. The product is never formed whole:

1. Documents with the same set are one row from the start.
2. A row's partner shares at least that percentage of the row's own n-grams. A row of n
   n-grams therefore needs a number of *shared* columns, known from n alone, among its
   first columns in a fixed order; later among all its columns. Rows below that bound
   can be in no link and are discarded, which removes nearly all documents, also those
   that merely quote a passage found in many others.
3. The rows left fall into clusters. Rows are in one if they share leading columns and may be
   linked by the counts of their columns by a few bits of the hash, which keeps apart what only
   shares a common passage. Each cluster is a block, or several blocks of bounded size; within a block, a row's overlaps with all others are
   accumulated column by column and compared with the bound of both sizes. Rows already
   linked to the block's first row are not multiplied with each other, since their
   component is settled, so a group of thousands of near copies costs one row of the product
   and leaves as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components

WORDS_HELD = 100_000
# N-grams in a block; what a task holds at a time.
BLOCK_NGRAMS = 1 << 20
# Entries of a product that are added up at a time.
PRODUCT_ENTRIES = 1 << 20
# Counters of the column order; their number is fixed, whatever the number of columns.
COUNTERS = 1 << 18
COUNTER_PART = 1 << 12
# Counts of a row's columns by their last bits, in one byte each; a power of two.
MARKS = 512
# Rows of one column that are compared with each other by their marks; more are tied together.
MARKED_ROWS = 1 << 14
# Up to so many rows of two numbers are sent to every task; beyond that both sides are shuffled.
SENT_ROWS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Join:
    """Words of an n-gram and the least Jaccard similarity in percent."""

    n: int = 4
    percent: int = 85

    def least(self, size: int) -> int:
        """Columns that a row of this size shares with any partner, at least."""
        return -(-self.percent * size // 100)

    def slack(self, size: int) -> int:
        return max(1, size // 20)

    def leading(self, size: int) -> int:
        """Columns, first in the fixed order, of which a linked pair shares ``needed``."""
        return min(size, size - self.least(size) + self.slack(size))

    def needed(self, size: int) -> int:
        """A partner has at least ``least(size)`` columns; both slacks are at least its slack."""
        return self.slack(self.least(size))

    def linked(self, overlap: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (size + sizes - overlap)

    def sizes(self, size: int) -> tuple[int, int]:
        """Least and largest size of a partner."""
        return self.least(size), 100 * size // self.percent


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Ngrams:
    """Sets of n-grams as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A text with fewer
    words than an n-gram has is one n-gram of all its words; without words the set is empty.
    """

    def __init__(self, n: int) -> None:
        self.n, self.words = n, _Words()

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.int64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(h))
        found = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            found = found * MULTIPLIER + h[k: len(h) - width + 1 + k]
        return np.unique(_mixed(found)).view(np.int64)


def _row_id(found: np.ndarray) -> tuple[int, int]:
    a = xxhash.xxh3_128_intdigest(found.tobytes())
    return (a >> 64) - (1 << 63), (a & ((1 << 64) - 1)) - (1 << 63)


def _in_order(found: np.ndarray) -> np.ndarray:
    """The fixed order of columns: by hash as an unsigned number."""
    return np.sort(found.view(np.uint64)).view(np.int64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _written(df: DataFrame, name: str) -> DataFrame:
    """As ``shared.written``; what was shuffled to make the table goes when it is complete."""
    with shared.shuffles_dropped(df.sparkSession):
        return shared.written(df, name)


SETS = "doc_id long, size long, row long, row2 long, leading binary"
ROWS = "row long, size long, columns binary"
LEADING = "row long, column long"


def document_sets(docs: DataFrame, join: Join) -> DataFrame:
    """Per document its set's size, a 128-bit name of the set, and its leading columns."""
    @shared.trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = Ngrams(join.n)
        for batch in batches:
            sizes, names, leading = [], [], []
            for text in batch.column(1):
                found = ngrams.of(text.as_py())
                sizes.append(len(found))
                names.append(_row_id(found))
                leading.append(_in_order(found)[: join.leading(len(found))].tobytes())
            yield _batch(SETS, batch.column(0), sizes, [a for a, _ in names], [b for _, b in names], leading)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, SETS)


# --- discarding rows by the columns they share -----------------------------------------

PART = "column long, row long, n int"
COUNT = "row long, n long"


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, and start and size of each group of equal keys in that order."""
    order = np.argsort(keys, kind="stable")
    ahead = keys[order]
    start = np.flatnonzero(np.append(True, ahead[1:] != ahead[:-1])) if len(keys) else np.empty(0, np.int64)
    return order, start, np.diff(np.append(start, len(keys)))


def shared_counts(rows: DataFrame, columns: str) -> DataFrame:
    """``row`` and ``n``: how many of its listed columns some other row lists as well.

    Every task first settles what its own rows share; a column then leaves the task once,
    however many of its rows hold it, so a column that a third of all rows hold meets in one
    place as one entry per batch. Rows without shared columns are left out.
    """
    @shared.trimmed
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            entries = np.concatenate(lists) if lists else np.empty(0, np.int64)
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists])
            order, start, n = _groups(entries)
            here = np.repeat(n > 1, n)
            own, times = np.unique(owner[order][here], return_counts=True)
            one = order[start]
            alone = n == 1
            # n > 0: a row's count so far, dealt by the row; n = 0: a column that one row of
            # this task holds; n = -1: a column that several rows of this task hold.
            yield _batch(PART, np.concatenate([own, entries[one]]),
                         np.concatenate([own, np.where(alone, owner[one], 0)]),
                         np.concatenate([times, np.where(alone, 0, -1)]).astype(np.int32))

    @shared.trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted(table: np.ndarray) -> pa.RecordBatch:
            column, row, n = table
            so_far = n > 0
            entry = ~so_far
            order, _, size = _groups(column[entry])
            several = np.repeat(size > 1, size)
            single = n[entry][order] == 0
            # One row per shared column: partial sums here would grow with the number of tasks.
            found = row[entry][order][several & single]
            return _batch(COUNT, np.concatenate([row[so_far], found]),
                          np.concatenate([n[so_far], np.ones(len(found), np.int64)]))

        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            if sum(t.shape[1] for t in held) < 1 << 19:
                continue
            # Sorted by column: the last column of what is held may go on in the next batch.
            table = np.concatenate(held, axis=1)
            cut = np.searchsorted(table[0], table[0, -1])
            if cut:
                yield counted(table[:, :cut])
            held = [table[:, cut:]]
        if held:
            yield counted(np.concatenate(held, axis=1))

    entries = rows.select("row", columns).mapInArrow(part, PART)
    # Explicit: the entries are many times the bytes of what they come from.
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = entries.repartition(count, "column").sortWithinPartitions("column").mapInArrow(meet, COUNT)
    return met.groupBy("row").agg(F.sum("n").alias("n"))


# --- the product within clusters -----------------------------------------------------------

LINK = "u long, v long"


class Block:
    """Rows of the matrix by column, for overlaps of one row with all of them."""

    def __init__(self, rows: np.ndarray, sets: list[np.ndarray]) -> None:
        self.rows, self.sets = rows, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        entries = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order, start, n = _groups(entries)
        self.column = entries[order][start]
        self.start, self.n = start, n
        self.holder = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, columns: np.ndarray) -> np.ndarray:
        """Counts of shared columns with each row of the block."""
        at = np.minimum(np.searchsorted(self.column, columns), max(0, len(self.column) - 1))
        at = at[self.column[at] == columns] if len(self.column) else at[:0]
        found, begin = np.zeros(len(self.rows), np.int64), 0
        total = np.cumsum(self.n[at])
        while begin < len(at):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + PRODUCT_ENTRIES)))
            start, n = self.start[at[begin:end]], self.n[at[begin:end]]
            shift = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n)
            found += np.bincount(self.holder[shift + np.arange(len(shift))], minlength=len(self.rows))
            begin = end
        return found

    def center(self) -> int:
        """The row whose columns are held most often on average."""
        held = np.bincount(self.holder, np.repeat(self.n, self.n), len(self.rows))
        return int(np.argmax(held / np.maximum(1, self.sizes)))

    def partners(self, columns: np.ndarray, join: Join) -> np.ndarray:
        return np.flatnonzero(join.linked(self.overlaps(columns), len(columns), self.sizes))


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] if y in self.up else y
            x = y
        return x

    def joined(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(stored: list[tuple[int, np.ndarray]], asking: list[tuple[int, np.ndarray]], join: Join,
                settled: bool) -> Iterator[tuple[int, int]]:
    """Links that join components: among the stored rows, and of the asking rows with them.

    The row whose columns are held by most others is multiplied first. Rows linked to it form
    one component, so only the others are multiplied with the block: of any pair between
    components one is multiplied. ``settled`` says that the stored rows of this block need no
    product among themselves.
    """
    if not stored:
        return
    block, forest = Block(np.array([r for r, _ in stored], np.int64), [s for _, s in stored]), _Forest()
    rows, star = asking, set()
    if not settled:
        k = block.center()
        star = set(block.rows[block.partners(block.sets[k], join)].tolist()) - {stored[k][0]}
        rows = [stored[k], *stored[:k], *stored[k + 1:]]
    for row, columns in rows:
        if row in star:
            continue
        found = block.rows[block.partners(columns, join)].tolist()
        for other in found:
            if other != row and forest.joined(row, other):
                yield row, other


def column_counts(rows: DataFrame) -> np.ndarray:
    """How many entries fall on each counter, a column's counter being part of its hash.

    A fixed number of counters comes to the driver, in parts that were added up before. They
    only order the columns: any order gives the same links, one with common columns at the
    end the fewest clusters.
    """
    @shared.trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column("columns"):
                seen += np.bincount(np.frombuffer(x.as_buffer(), np.int64) & (COUNTERS - 1), minlength=COUNTERS)
        yield _batch("part long, counts binary", range(COUNTERS // COUNTER_PART),
                     [x.tobytes() for x in seen.reshape(-1, COUNTER_PART)])

    @shared.trimmed
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[k] = held.get(k, 0) + np.frombuffer(x.as_buffer(), np.int64)
        if held:
            yield _batch("part long, counts binary", [*held], [x.tobytes() for x in held.values()])

    kind = "part long, counts binary"
    added = rows.select("columns").mapInArrow(count, kind).repartition(COUNTERS // COUNTER_PART, "part").mapInArrow(add, kind)
    found = np.zeros((COUNTERS // COUNTER_PART, COUNTER_PART), np.int64)
    for k, x in added.collect():
        found[k] = np.frombuffer(x, np.int64)
    return found.reshape(-1)


def leading_columns(rows: DataFrame, join: Join) -> DataFrame:
    """``row`` and ``column``: the first columns of each row, rarest first, of which any linked
    pair shares at least one."""
    held = rows.sparkSession.sparkContext.broadcast(column_counts(rows))

    @shared.trimmed
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            found = []
            for x in batch.column("columns"):
                columns = np.frombuffer(x.as_buffer(), np.int64)
                by = np.lexsort((columns, counts[columns & (COUNTERS - 1)]))
                found.append(columns[by[: len(columns) - join.least(len(columns)) + 1]])
            own = np.repeat(batch.column("row").to_numpy(), [len(f) for f in found])
            yield _batch(LEADING, own, np.concatenate(found) if found else [])

    return rows.select("row", "columns").mapInArrow(lead, LEADING)


def _marks(columns: np.ndarray) -> bytes:
    return np.minimum(np.bincount(columns & (MARKS - 1), minlength=MARKS), 255).astype(np.uint8).tobytes()


def close_pairs(rows: np.ndarray, sizes: np.ndarray, marks: np.ndarray, join: Join) -> Iterator[tuple[int, int]]:
    """Pairs that connect all rows which their sizes and marks allow to be linked, directly or by others.

    Two rows differ in at least as many columns as their marks do, so no link is lost.
    """
    order = np.argsort(sizes, kind="stable")
    rows, sizes, marks = rows[order], sizes[order], marks[order]
    left = np.ones(len(rows), bool)
    for first in range(len(rows)):
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            k = todo.pop()
            least, most = join.sizes(int(sizes[k]))
            begin, end = np.searchsorted(sizes, least), np.searchsorted(sizes, most, side="right")
            asked = begin + np.flatnonzero(left[begin:end])
            for part in np.split(asked, range(2048, len(asked), 2048)):
                apart = np.abs(marks[part].astype(np.int16) - marks[k]).sum(axis=1, dtype=np.int64)
                hit = part[join.linked((sizes[part] + sizes[k] - apart) // 2, int(sizes[k]), sizes[part])]
                left[hit] = False
                todo += hit.tolist()
                yield from zip(rows[hit].tolist(), [int(rows[k])] * len(hit))


def clusters(rows: DataFrame, leading: DataFrame, join: Join) -> DataFrame:
    """``row`` and ``cluster``: rows that share leading columns and are close, directly or by others.

    Columns that the same rows hold give the same pairs; one of them is looked at. Rows that are
    close to no other are left out.
    """
    held = leading.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).filter("n > 1")
    chosen = held.groupBy("n", "a", "b").agg(F.min("column").alias("column")).select("column")

    @shared.trimmed
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_marks(np.frombuffer(x.as_buffer(), np.int64)) for x in batch.column(2)]
            yield _batch("row long, size long, marks binary", batch.column(0), batch.column(1), found)

    marked = rows.select("row", "size", "columns").mapInArrow(mark, "row long, size long, marks binary")
    met = leading.join(chosen, "column").join(marked, "row").select("column", "row", "size", "marks")

    @shared.trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tied = None, None

        def pairs(column: np.ndarray, row: np.ndarray, size: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            found: set[tuple[int, int]] = set()
            start = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            for a, b in zip(start, np.append(start[1:], len(column))):
                if column[a] == tied or b - a > MARKED_ROWS:
                    found.update((x, int(row[a])) for x in row[a + 1: b].tolist())
                elif b - a > 1:
                    found.update(close_pairs(row[a:b], size[a:b], marks[a:b], join))
            return _batch(LINK, [u for u, _ in found], [v for _, v in found])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = [*[batch.column(k).to_numpy() for k in range(3)],
                     np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, MARKS)]
            table = table if held is None else [np.concatenate(x) for x in zip(held, table)]
            # Sorted by column: the last column may go on in the next batch.
            cut = np.searchsorted(table[0], table[0][-1])
            if cut:
                yield pairs(*[x[:cut] for x in table])
            held = [x[cut:] for x in table]
            if len(held[0]) > MARKED_ROWS or held[0][0] == tied:
                tied = held[0][0]
                yield pairs(*held)
                held = [x[:1] for x in held]
        if held is not None:
            yield pairs(*held)

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.repartition(count, "column").sortWithinPartitions("column").mapInArrow(meet, LINK)
    return components(_written(pairs, "pairs")).select(F.col("id").alias("row"), F.col("root").alias("cluster"))


def placed_rows(rows: DataFrame, join: Join) -> DataFrame:
    """``row``, ``cluster``, its number of ``blocks``, the row's ``block``, and ``best``, the row of
    the cluster with the most common columns."""
    leading = _written(leading_columns(rows, join), "leading")
    placed = _written(rows.select("row", "size", "common").join(clusters(rows, leading, join), "row"), "clustered")
    weight = placed.groupBy("cluster").agg(
        F.ceil(F.sum("size") / BLOCK_NGRAMS).cast("int").alias("blocks"),
        F.max(F.struct(F.col("common") / F.col("size"), "row")).alias("best"))
    found = _written(placed.join(weight, "cluster").select(
        "row", "cluster", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"),
        F.col("best.row").alias("best")), "placed")
    for table in (leading, placed):
        shared.removed(rows.sparkSession, table)
    return found


def links(rows: DataFrame, join: Join) -> DataFrame:
    """Links (u, v) that connect what is linked, from stored rows with their whole ``columns``,
    each ``row`` once.

    A cluster of one block is multiplied in one task. A cluster of several is first compared
    with one of its rows, the one with the most common columns; rows linked to it are
    settled, and the others ask every block of the cluster.
    """
    spark = rows.sparkSession
    placed = placed_rows(rows, join)
    grouped = _written(rows.select("row", "columns").join(placed, "row"), "grouped")
    small = grouped.filter("blocks = 1").select(
        "cluster", "block", F.lit(0).alias("asks"), F.lit(False).alias("settled"), "row", "columns")

    wide = grouped.filter("blocks > 1")
    pivots = wide.filter("row = best").select("cluster", F.col("columns").alias("_p")).groupBy(
        "cluster").agg(F.first("_p").alias("_p"))
    tested = _written(wide.join(pivots, "cluster").withColumn(
        "star", _is_linked(join)(F.col("columns"), F.col("_p"))).drop("_p"), "stars")
    stars = tested.filter("star").select(F.col("row").alias("u"), F.col("best").alias("v"))
    asks = tested.filter("NOT star").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("asks"), F.lit(True).alias("settled"), "row", "columns")
    stores = tested.select("cluster", "block", F.lit(0).alias("asks"), F.lit(True).alias("settled"), "row", "columns")

    @shared.trimmed
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stored, asking, settled, found = None, [], [], False, []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "block", "asks", "settled", "row")]
            for cluster, block, ask, done, row, x in zip(*columns, batch.column("columns")):
                if (cluster, block) != at:
                    found += block_links(stored, asking, join, settled)
                    at, stored, asking, settled = (cluster, block), [], [], done
                (asking if ask else stored).append((row, np.frombuffer(x.as_buffer(), np.int64)))
                if len(asking) == 4096:
                    found += block_links(stored, asking, join, settled)
                    asking = []
            if found:
                yield _batch(LINK, [u for u, _ in found], [v for _, v in found])
                found = []
        found += block_links(stored, asking, join, settled)
        if found:
            yield _batch(LINK, [u for u, _ in found], [v for _, v in found])

    units = small.unionByName(stores).unionByName(asks)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(count, "cluster", "block").sortWithinPartitions("cluster", "block", "asks")
    found = _written(units.mapInArrow(multiply, LINK).unionByName(stars), "links")
    for table in (placed, grouped, tested):
        shared.removed(spark, table)
    return found


def _is_linked(join: Join):
    @F.udf("boolean", useArrow=False)
    def linked(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        n = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * n >= join.percent * (len(x) + len(y) - n)
    return linked


# --- the join ----------------------------------------------------------------------------------


def similar_documents(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document (``doc_id``, ``text``).

    As ``text_components``; other columns are not read, and an empty table gives no rows.
    """
    return text_components(docs, join).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def text_components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id``, ``size`` and 128-bit name (``row``, ``row2``) of every text's set, ``component_id``.

    ``component_id`` is the smallest id reachable by links. A null or empty text has an empty
    set and is linked with nothing. Rows with the same id are one node of the graph if their
    texts are alike; a null id keeps a null component unless it has copies with an id.
    """
    wide = _written(document_sets(docs, join), "sets")
    spark = docs.sparkSession
    sets = _written(wide.drop("leading"), "names")
    size = F.col("size")
    least = F.ceil(F.lit(join.percent) * size / 100)
    needed = F.greatest(F.lit(1), F.floor(least / 20))
    # Copies share all their columns; that keeps a row they do not need, and loses none.
    counts = shared_counts(wide.filter("size > 0"), "leading")
    rows = _written(sets.filter("size > 0").groupBy("row", "row2", "size").agg(
        F.min("doc_id").alias("first")), "classes")
    alive = rows.select("row", "first", "size").join(counts, "row").filter(F.col("n") >= needed)
    alive = _written(alive.select("row", "first"), "alive")
    shared.removed(spark, wide)

    @shared.trimmed
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = Ngrams(join.n)
        for batch in batches:
            kept = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                found = ngrams.of(text.as_py())
                if _row_id(found)[0] == row:
                    kept.append((row, found.tobytes()))
            yield _batch(ROWS, [r for r, _ in kept], [len(s) // 8 for _, s in kept], [s for _, s in kept])

    few = alive.count() <= SENT_ROWS
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        _sent(alive.withColumnRenamed("first", "doc_id"), few), "doc_id").select("row", "text")
    whole_sets = _written(texts.mapInArrow(whole, ROWS), "whole")
    counts = shared_counts(whole_sets, "columns").withColumnRenamed("n", "common")
    full = _written(whole_sets.join(_sent(counts, few), "row").filter(F.col("common") >= least), "rows")
    for table in (alive, whole_sets):
        shared.removed(spark, table)
    if full.select("row").distinct().count() < full.count():
        # Rows that repeat id and text.
        before, full = full, _written(full.dropDuplicates(["row"]), "once")
        shared.removed(spark, before)
    found = links(full, join)
    shared.removed(spark, full)
    linked = components(found)
    joined = rows.select("row", "row2", "first").join(
        linked.withColumnRenamed("id", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    # A group of copies may hold any share of the documents; its row is found by a safe join.
    named = joined.join(smallest, "root").select("row", "row2", "component_id", "first")
    named = _back(sets, named)
    for table in (rows, found):
        shared.removed(spark, table)
    return named


def _sent(rows: DataFrame, few: bool) -> DataFrame:
    """To be joined by broadcast if it is known to have at most ``SENT_ROWS`` rows."""
    return F.broadcast(rows) if few else rows


def _back(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Every document with its class's component.

    Only classes with another document carry news; a document alone in its class and its
    component is its own. The hot classes, each over 1/200 of all documents and so fewer
    than 200, meet their documents by broadcast.
    """
    total = sets.count()
    news = named.join(sets.groupBy("row", "row2").agg(F.count(F.lit(1)).alias("_n")), ["row", "row2"])
    news = _written(news.filter("_n > 1 OR component_id <> first").select("row", "row2", "component_id", "_n"), "news")
    hot = news.filter(F.col("_n") > max(1, total // 200)).select("row", "row2", F.col("component_id").alias("_hot"))
    cold = news.filter(F.col("_n") <= max(1, total // 200)).select("row", "row2", "component_id")
    some = sets.select("doc_id", "size", "row", "row2").join(F.broadcast(hot), ["row", "row2"], "left")
    warm = some.filter("_hot IS NOT NULL").withColumn("component_id", F.col("_hot"))
    rest = some.filter("_hot IS NULL").join(cold, ["row", "row2"], "left")
    columns = ["doc_id", "size", "row", "row2"]
    return warm.select(*columns, "component_id").unionByName(rest.select(*columns, "component_id")).select(
        *columns, F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents whose id is their component's, with all their columns; repeated rows once.

    Where rows share an id but not a text, each text stays or goes by its own component. A
    document without an id stays.
    """
    found = _written(text_components(docs, join), "components")
    gone = _written(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", "row", "row2").distinct(), "gone")
    again = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = _written(again, "again")
    n = again.count()
    # Texts travel only if too many documents go for their ids to be sent to every task.
    once = docs.join(_sent(gone.select("doc_id").distinct(), gone.count() <= SENT_ROWS), "doc_id", "left_anti").select(*docs.columns)
    if not n:
        return once
    few = n <= SENT_ROWS
    row, row2 = shared.free_name(docs.columns, "row"), shared.free_name(docs.columns, "row2")
    twice = _with_names(docs.join(_sent(again, few), "doc_id", "left_semi").select(*docs.columns), join, row, row2)
    off = gone.join(_sent(again, few), "doc_id", "left_semi").select(
        "doc_id", F.col("row").alias(row), F.col("row2").alias(row2))
    kept = twice.join(off, ["doc_id", row, row2], "left_anti").select(*docs.columns).dropDuplicates()
    return once.join(_sent(again, few), "doc_id", "left_anti").select(*docs.columns).unionByName(kept)


def _with_names(docs: DataFrame, join: Join, row: str, row2: str) -> DataFrame:
    """The documents with the names of their texts' sets."""
    place, listed = docs.columns.index("text"), [*docs.columns, row, row2]

    @shared.trimmed
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = Ngrams(join.n)
        for batch in batches:
            names = [_row_id(ngrams.of(text.as_py())) for text in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)]], listed)

    return docs.mapInArrow(named, T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in (row, row2)]]))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component; nulls, copies and repeated ids as ``text_components`` says."""
    return similar_documents(shared.table(spark, sf_dir, "documents"))
