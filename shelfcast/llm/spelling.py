"""Spelling variants: words one edit apart, found with full-text indexes of the vocabulary.

Words that differ by one code point share one half of the shorter (or, for a replaced code
point, of either). The vocabulary is filed under its halves in blocks. A block's words lie in
one text with a delimiter around each, indexed by its sorted suffixes: once as written and
once reversed, so that a search may begin at either end of a word. A search matches the half
at that end exactly, as an interval of suffix ranks, then extends it over the other half,
where one step may take another code point or one more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Different words that a task counts before it sends them on.
WORDS_HELD = 300_000
# Filed words in a block, and the size from which a half's words are dealt to several blocks.
BLOCK_WORDS = 1 << 15
HOT_WORDS = 1 << 16
# A half is dealt out only if it also has this share of all filed words, so that there are
# fewer such halves than its inverse and their list may be broadcast.
HOT_SHARE = 1e-4
# Words searched for side by side.
QUERIES = 4096


@dataclass(frozen=True)
class Rules:
    """Which words count and when one is a variant of another.

    ``damage``: every run whose hash with its document's id is divisible by it loses one code
    point; 0 for none. ``ratio``: how many times more often a form must occur.
    """

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    damage: int = 31


def _words(key: object, text: str, run: re.Pattern, rules: Rules) -> Iterator[tuple[str, int]]:
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for word, n in Counter(run.findall(text)).items():
        word = word.lower() if word.isascii() else word.translate(LOWER)
        if rules.damage:
            h = zlib.crc32(word.encode(), start)
            if h % rules.damage == 0:
                if len(word) <= rules.least_length:
                    continue
                at = h % len(word)
                word = word[:at] + word[at + 1:]
        yield word, n


def word_counts(docs: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all texts. A null text has no words; a null id is hashed as nothing.

    Tasks count in a bounded memory and send partial counts, so a word that fills a third of
    all texts is a few rows of the shuffle.
    """
    run = re.compile(f"[{LETTERS}]{{{rules.least_length},}}")

    @shared.trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held.clear()

        for batch in batches:
            for key, whole in zip(batch.column(0), batch.column(1)):
                if not whole.is_valid:
                    continue
                for word, n in _words(key.as_py(), whole.as_py(), run, rules):
                    held[word] = held.get(word, 0) + n
                if len(held) >= WORDS_HELD:
                    yield from sent()
        yield from sent()

    return docs.select(doc, text).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= rules.least_count)


class SuffixRanks:
    """A full-text index over sorted words that are each enclosed in delimiters (byte 0).

    Suffixes are compared up to the next delimiter and then by place, which is the order of
    the words that follow. The k-th delimiter therefore has rank k, and an interval that has
    been extended over the opening delimiter holds the numbers of the words found.
    """

    def __init__(self, words: list[bytes]) -> None:
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        n = self.size = len(text)
        stops = np.flatnonzero(text == 0)
        self.delimiters = len(stops)
        left = (stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)).astype(np.int32)
        rank, width = self._first_ranks(text, left)
        while width <= left.max(initial=0):
            ahead = np.where(left >= width, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
            width *= 2
        order = np.argsort(rank, kind="stable")
        # The code point before each suffix; the first delimiter has none.
        self.before = text[order - 1]
        by = np.argsort(self.before, kind="stable")
        by = by[by != np.flatnonzero(order == 0)[0]]
        self.places = self.before[by].astype(np.int64) * n + by
        self.letters = np.unique(text[text > 0])

    @staticmethod
    def _first_ranks(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
        key = np.zeros(len(text), np.uint64)
        for i in range(8):
            code = np.zeros(len(text), np.uint64)
            code[: len(text) - i] = text[i:]
            key = (key << np.uint64(8)) | np.where(left > i, code, np.uint64(0))
        return np.unique(key, return_inverse=True)[1].astype(np.int64), 8

    def step(self, code: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rank that ``rank`` becomes when suffixes are extended by ``code`` at their front."""
        return np.searchsorted(self.places, code.astype(np.int64) * self.size + rank) + (code > 0)

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of the interval, code, low, high) of every extension by one code point that occurs.

        Equal intervals, such as those of words with the same half, are extended once.
        """
        pairs, which = np.unique(low * (self.size + 1) + high, return_inverse=True)
        low, high = pairs // (self.size + 1), pairs % (self.size + 1)
        few = high - low <= len(self.letters)
        many = np.flatnonzero(~few)
        some = np.flatnonzero(few)
        lengths = (high - low)[some]
        rows = np.repeat(some, lengths)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = self.before[low[rows] + inside]
        seen = np.unique(rows * 256 + codes)
        rows = np.concatenate([seen // 256, np.repeat(many, len(self.letters))])
        codes = np.concatenate([seen % 256, np.tile(self.letters, len(many))])
        rows, codes = rows[codes > 0], codes[codes > 0]
        down, up = self.step(codes, low[rows]), self.step(codes, high[rows])
        there = np.flatnonzero(up > down)
        there = there[np.argsort(rows[there], kind="stable")]
        rows, codes, down, up = rows[there], codes[there], down[there], up[there]
        # Deal the extensions to all rows with the same interval.
        count = np.bincount(rows, minlength=len(pairs))
        start = np.cumsum(count) - count
        own = np.repeat(np.arange(len(which)), count[which])
        each = np.arange(len(own)) - np.repeat(np.cumsum(count[which]) - count[which], count[which])
        at = start[which][own] + each
        return own, codes[at], down[at], up[at]


def near(index: SuffixRanks, words: list[bytes], exact: np.ndarray, at_border: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the searched word, number of the indexed word, whether that is longer).

    Searched words end in ``exact`` code points that the found ones share; before them one
    code point is replaced or one more stands. One more is only looked for at the outer end
    of a run of its kind, so every word is found once; ``at_border``: also right before the
    exact half.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer(b"\0" + b"\0".join(words), np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    for first in range(0, len(words), QUERIES):
        q = np.arange(first, min(first + QUERIES, len(words)))
        low, high = np.zeros(len(q), np.int64), np.full(len(q), index.delimiters, np.int64)
        for t in range(int(exact[q].max(initial=0))):
            on = np.flatnonzero(exact[q] > t)
            code = codes[ends[q[on]] - t]
            low[on], high[on] = index.step(code, low[on]), index.step(code, high[on])
        used, states = exact[q].copy(), []
        while len(q):
            there = (high > low) & (used <= lengths[q])
            q, low, high, used = q[there], low[there], high[there], used[there]
            if not len(q):
                break
            following = codes[ends[q] - used]
            own, code, down, up = index.extended(low, high)
            other = code != following[own]
            own, down, up = own[other], down[other], up[other]
            inside = used[own] < lengths[q[own]]
            more = np.ones(len(own), bool) if at_border else used[own] > exact[q[own]]
            states.append([np.concatenate([a[inside], b[more]]) for a, b in (
                (q[own], q[own]), (down, down), (up, up), (used[own] + 1, used[own]),
                (np.zeros(len(own), bool), np.ones(len(own), bool)))])
            on = used < lengths[q]
            q, low, high, used, following = q[on], low[on], high[on], used[on], following[on]
            low, high, used = index.step(following, low), index.step(following, high), used + 1
        if not states:
            continue
        q, low, high, used, longer = (np.concatenate(c) for c in zip(*states))
        while len(q):
            code = codes[ends[q] - used]
            low, high = index.step(code, low), index.step(code, high)
            there = high > low
            q, low, high, used, longer, code = (a[there] for a in (q, low, high, used, longer, code))
            over = code == 0
            count = (high - low)[over]
            rows = np.repeat(q[over], count)
            found = np.repeat(low[over], count) + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            yield rows, found, np.repeat(longer[over], count)
            q, low, high, used, longer = (a[~over] for a in (q, low, high, used + 1, longer))


FILED = "bucket int, is_query boolean, key long, word string, n long, exact int"
FOUND = "word string, n_near long, form_n long, form string"


def _best(of: np.ndarray, words: list[str], near_n: np.ndarray, near_rank: np.ndarray, near_words: list[str],
          other: np.ndarray) -> pa.RecordBatch:
    """One row per word of ``of``: how many are near, and the first of them by count and order."""
    order = np.lexsort((near_rank[other], -near_n[other], of))
    of, other = of[order], other[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, int)
    best = other[starts]
    return pa.RecordBatch.from_arrays([
        pa.array([words[i] for i in of[starts]], pa.string()), pa.array(np.diff(np.append(starts, len(of))), pa.int64()),
        pa.array(near_n[best], pa.int64()), pa.array([near_words[i] for i in best], pa.string())],
        ["word", "n_near", "form_n", "form"])


def _block(side: int, filed: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words within a block: of the words asked for, and of the longer words they find."""
    turn = -1 if side == 0 else 1
    coded = [w.encode("latin-1")[::turn] for w in filed.column("word").to_pylist()]
    order = sorted(range(len(coded)), key=coded.__getitem__)
    index = SuffixRanks([coded[i] for i in order])
    filed = filed.take(pa.array(order, pa.int64()))
    words, n, keys = filed.column("word").to_pylist(), filed.column("n").to_numpy(), filed.column("key").to_numpy()
    rank = np.unique(np.array(words, object), return_inverse=True)[1]
    asked_words, asked_n = asked.column("word").to_pylist(), asked.column("n").to_numpy()
    asked_keys, exact = asked.column("key").to_numpy(), asked.column("exact").to_numpy().astype(np.int64)
    asked_rank = np.unique(np.array(asked_words, object), return_inverse=True)[1]
    left = [w[: len(w) // 2] for w in asked_words]
    for q, i, longer in near(index, [w.encode("latin-1")[::turn] for w in asked_words], exact, side == 0):
        mine = keys[i] == asked_keys[q]
        if side == 1:
            # Longer words that also share the left half are found from the other side.
            mine[np.flatnonzero(longer)] &= np.array([not words[b].startswith(left[a]) for a, b in zip(q[longer], i[longer])], bool)
        q, i, longer = q[mine], i[mine], longer[mine]
        if len(q):
            yield _best(q, asked_words, n, rank, words, i)
        if longer.any():
            yield _best(i[longer], words, asked_n, asked_rank, asked_words, q[longer])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, filed words before words asked for."""
    at, held = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held)
            query = rows.column("is_query")
            filed, asked = rows.filter(pc.invert(query)), rows.filter(query)
            if len(filed) and len(asked):
                yield from _block(at % 2, filed, asked)
        held.clear()

    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for start, end in zip(cuts, [*cuts[1:], len(bucket)]):
            if bucket[start] != at:
                yield from answers()
                at = int(bucket[start])
            held.append(batch.slice(start, end - start))
    yield from answers()


def near_words(words: DataFrame) -> DataFrame:
    """Partial rows of near words: add up ``n_near`` by word and take the greatest ``form_n``.

    Every word is filed under the halves of a word of its own length and of one that is a
    code point shorter, and is searched for under its own two halves; the shorter word of a
    pair finds the longer. Halves with very many words are dealt to several blocks, with the
    words that ask for them copied to each.
    """
    half = "named_struct('side', {0}, 'half', {1}, 'is_query', {2}, 'exact', {3})"
    left, right = "substring(word, 1, {0})", "right(word, {0})"
    forms = [half.format(0, left.format("l div 2"), "true", "l div 2"),
             half.format(1, right.format("l - l div 2"), "true", "l - l div 2"),
             half.format(0, left.format("l div 2"), "false", "0"), half.format(0, left.format("(l - 1) div 2"), "false", "0"),
             half.format(1, right.format("l - l div 2"), "false", "0"),
             half.format(1, right.format("l - 1 - (l - 1) div 2"), "false", "0")]
    rows = words.withColumn("l", F.length("word")).select(
        "word", "n", F.explode(F.expr(f"array_distinct(array({', '.join(forms)}))")).alias("f")).select(
        "word", "n", "f.side", "f.is_query", F.col("f.exact").cast("int").alias("exact"),
        F.xxhash64("f.side", "f.half").alias("key"))
    filed = 4 * words.count()
    bound = max(HOT_WORDS, int(filed * HOT_SHARE))
    hot = shared.written(rows.filter("NOT is_query").groupBy("key").count().filter(F.col("count") > bound).select(
        F.col("key").alias("hot"), F.ceil(F.col("count") / bound).cast("int").alias("parts")), "hot-halves")
    blocks = max(1, -(-filed // BLOCK_WORDS))
    dealt = rows.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.when(
            F.col("is_query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
            F.array(F.pmod(F.hash("word"), F.col("parts"))))))
    bucket = F.pmod(F.xxhash64("key", "part"), F.lit(blocks)) * 2 + F.col("side")
    return dealt.select(bucket.cast("int").alias("bucket"), "is_query", "key", "word", "n", "exact").repartition(
        min(2 * blocks, 1 << 17), "bucket").sortWithinPartitions("bucket", "is_query").mapInArrow(shared.trimmed(_search), FOUND)


def variants(words: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of a table (word, n) without repeats.

    A form occurs at least ``ratio`` times as often as its word, so a chain of forms has at
    most as many links as a count has digits, and is followed by doubling.
    """
    both = near_words(words).withColumn("n", F.lit(None).cast("long")).unionByName(words.select(
        "word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"),
        F.lit(None).cast("string").alias("form"), "n"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    rows = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    is_form = -F.col("b.m") >= rules.ratio * F.col("n")
    rows = shared.written(rows.select(
        "word", "n", "n_near", F.when(is_form, F.col("b.form")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")),
        "variants")
    ends, longer = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), True
    while longer:
        after = ends.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ends = shared.written(ends.join(after, ends.root == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        longer = bool(ends.filter("moved").limit(1).count())
        ends = ends.drop("moved")
    found = rows.filter("form IS NOT NULL").join(ends, "word")
    return rows.filter("form IS NULL").withColumn("root", F.col("word")).unionByName(found)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all texts with its near words, its form and the end of its chain of forms.

    Null and empty texts have no words, an empty table gives no rows, repeated rows count as
    often as they stand, and other columns are not read.
    """
    words = shared.written(word_counts(shared.table(spark, sf_dir, "documents")), "words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
