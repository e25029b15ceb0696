"""Quality rules on repetition inside a text, from its suffix array over words.

Words are runs of bytes other than ASCII white space. Texts are put side by side in a
batch and sorted together, with suffixes of different texts never alike, so the arrays of
many short texts cost a few sorts and one long text is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Words sorted together; a text over this is a batch of its own.
BATCH_WORDS = 400_000


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; ``window`` is also the shortest repeat that counts.

    ``max_longest`` is in words: a text that holds a passage of that length twice is
    rejected however long the rest of it is.
    """

    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    max_covered: float = 0.3
    max_longest: int = 100


def suffix_order(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, with the ranks of windows of 1, 2, 4, ... words.

    ``key`` tells words apart, and words of different texts; ``end`` is where the text of
    each position ends. Suffixes that are alone in their group are settled and are not
    sorted again. Two windows have the same rank only if they are the same words.
    """
    n = len(key)
    places = np.arange(n, dtype=np.int64)
    order = np.argsort(key, kind="stable")
    ahead = key[order]
    first = np.empty(n, bool)
    first[:1], first[1:] = True, ahead[1:] != ahead[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, places, 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, levels
        at = order[slots]
        then = at + width
        inside = then < end[at]
        second = np.where(inside, rank[np.minimum(then, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[slots] = at
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, both[1:] != both[:-1]
        first[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.astype(np.int32))
        width *= 2


def longest_repeats(key: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Per position the length of its longest repeat in the text, 0 if under ``least``.

    That is the deepest interval of common prefixes that holds the suffix: the longer of
    the common prefixes with its two neighbours in suffix order.
    """
    found = np.zeros(len(key), np.int64)
    if len(key) < 2:
        return found
    order, levels = suffix_order(key, end)
    a, b = order[:-1], order[1:]
    # Only neighbours that share the widest window not over ``least`` can matter.
    widest = min(len(levels), least.bit_length()) - 1
    if (1 << widest) * 2 <= least and widest == len(levels) - 1 and len(levels) < least.bit_length():
        return found
    near = levels[widest][a] == levels[widest][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        last = len(key) - 1
        same = inside & (levels[level][np.minimum(x, last)] == levels[level][np.minimum(y, last)])
        common += same * (1 << level)
    common[common < least] = 0
    np.maximum.at(found, a, common)
    np.maximum.at(found, b, common)
    return found


def maximal_spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of repeats that cannot be extended to either side.

    A repeat that starts one word earlier and ends at the same word contains this one.
    """
    starts = np.flatnonzero(found)
    before = np.append(0, found[:-1])[starts]
    starts = starts[before != found[starts] + 1]
    return starts, starts + found[starts]


class _Batch:
    """Texts whose words are sorted together."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []

    def add(self, text: str | None) -> int:
        words = (text or "").encode().split()
        ids = self.ids
        for word in set(words).difference(ids):
            ids[word] = len(ids)
        self.words.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        return len(words)

    def repeats(self, least: int) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """Per text: maximal repeat starts, ends, words covered by their union, longest."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = owner * (len(self.ids) + 1) + (np.concatenate(self.words) if self.words else 0)
        found = longest_repeats(key, ends[owner], least)
        starts, stops = maximal_spans(found)
        depth = np.zeros(len(key) + 1, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, stops, -1)
        covered = np.append(0, np.cumsum(np.cumsum(depth[:-1]) > 0))
        out = []
        cuts = np.searchsorted(starts, np.append(0, ends))
        for k, end in enumerate(ends.tolist()):
            begin, own = end - int(sizes[k]), slice(cuts[k], cuts[k + 1])
            longest = int((stops[own] - starts[own]).max(initial=0))
            out.append((starts[own] - begin, stops[own] - begin, int(covered[end] - covered[begin]), longest))
        return out


METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, longest_repeat long, covered_fraction double, "
           "repeat_starts array<long>, repeat_ends array<long>")


def _metrics(texts: list[str | None], rules: Rules) -> list[tuple]:
    out: list[tuple] = []
    at = 0
    while at < len(texts):
        batch, words, counts, begin = _Batch(), 0, [], at
        while at < len(texts) and (words < BATCH_WORDS or not counts):
            counts.append(batch.add(texts[at]))
            words += counts[-1]
            at += 1
        for text, n, (starts, stops, covered, longest) in zip(texts[begin:at], counts, batch.repeats(rules.window)):
            text = text or ""
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            failed = n < rules.min_words or 100 * covered > rules.max_repeat_percent * n
            share = covered / n if n else 0.0
            kept = not failed and share <= rules.max_covered and longest <= rules.max_longest
            out.append((
                n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)), covered, failed, kept, longest, share,
                starts.tolist(), stops.tolist()))
    return out


def repetition_report(docs: DataFrame, doc: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document with its counts, verdict, and maximal repeats as word spans.

    A null or empty text has no words and fails. Repeated rows are judged one by one.
    """
    @shared.trimmed
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _metrics(batch.column(1).to_pylist(), rules)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(judge, f"doc_id {kind}, {METRICS}")


NAMES = [part.split(" ")[0] for part in METRICS.split(", ")]
TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), *[pa.list_(pa.int64())] * 2]


def quality_kept(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents whose text passes, with all their columns as they are."""
    place = docs.columns.index(text)

    @shared.trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [row[6] for row in _metrics(batch.column(place).to_pylist(), rules)]
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null, empty and repeated rows as ``repetition_report`` says."""
    return repetition_report(shared.table(spark, sf_dir, "documents")).drop("repeat_starts", "repeat_ends")
