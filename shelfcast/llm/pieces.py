"""Encoding and decoding with a SentencePiece model under seeded merge-dropout.

Pieces are merged best score first from an agenda, as the model's own encoder does. Each
candidate merge that comes up is skipped with a given probability, by a hash of the seed, the
document, the place of the word in it and the candidate's number; so a run with the same seed
cuts every document alike wherever it is processed, while a word that comes again is cut in
other ways. What is not merged falls back to characters and bytes, so every cut decodes to
the text itself.

Words of a block of texts whose cut is not known yet are merged side by side: one row of a
matrix is one word, and each round takes the best candidate of every row's agenda.
"""

from __future__ import annotations

import functools
import gc
import heapq
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SEED = 20240229
DROPOUT = 0.1
# Cuts of words that a task remembers.
CUTS_HELD = 400_000
# Decisions on candidates that are drawn beforehand, as bits, and the fourths of a hash they take.
DRAWN = 24
LOW = [(1 << t) - 1 for t in range(DRAWN + 1)]
BIT = [1 << t for t in range(DRAWN + 1)]
# Characters of the texts whose new words are merged together; a longer text is a block of its own.
BLOCK_CHARS = 1 << 21
# Longer words are cut anew wherever they stand; beyond the widest matrix each has an agenda.
LONGEST_HELD = 40
WIDTHS = (8, 12, 16, 24, 64)
CELLS = 1 << 19
ALL_BITS = (1 << 64) - 1
# Odd multipliers that spread the place of a word and the number of a candidate, and those of
# the finishing steps.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FINISH = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACE = "▁"
# A run of spaces and the word after it: no piece of the model has a space behind a letter.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
RAW_WORD = re.compile(" *[^ ]+| +")


class PieceModel:
    """The vocabulary of a model with byte fallback whose normalisation keeps a text as it is."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        fixed = {i for i in range(n) if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in fixed and not self.model.is_byte(i)}
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans words; words cannot be cut one by one")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Numbers for pieces, then for single characters that only occur inside pieces; one
        more stands for all else. Pairs of numbers that make a piece are sorted for look-up."""
        symbols = {p: k for k, p in enumerate(self.ids)}
        self.n_pieces = len(symbols)
        for c in sorted({c for p in self.ids for c in p}.difference(symbols)):
            symbols[c] = len(symbols)
        self.other = len(symbols)
        self.piece_ids = np.array(list(self.ids.values()), "<u4")
        self.of_char = np.full(sys.maxunicode + 1, self.other, np.int32)
        for c, k in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        pairs = sorted(
            (symbols[p[:k]] * (self.other + 1) + symbols[p[k:]], whole, self.scores[p])
            for p, whole in symbols.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pairs = np.array([x[0] for x in pairs], np.int64)
        self.wholes = np.array([x[1] for x in pairs], np.int32)
        self.pair_scores = np.array([x[2] for x in pairs], np.float32)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of the piece that two symbols make; minus infinity if none."""
        wanted = left.astype(np.int64) * (self.other + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_scores[at], -np.inf), self.wholes[at]

    def merged(self, word: str, key: int, dropout: float) -> list[str]:
        """The pieces of a word from single characters, best score first, then from the left.

        Every candidate that the agenda brings up is skipped if the hash of ``key``, which
        stands for the word's place in its document, and the candidate's number says so.
        """
        size, limit, number = len(word), skip_limit(dropout), 0
        start, end = list(range(size)), list(range(1, size + 1))
        before, after = [k - 1 for k in range(size)], [k + 1 for k in range(size)]
        agenda: list[tuple[float, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right < size:
                score = self.scores.get(word[start[left]: end[right]])
                if score is not None:
                    heapq.heappush(agenda, (-score, start[left], end[left], end[right]))

        for k in range(size - 1):
            propose(k, k + 1)
        alive = [True] * size
        while agenda:
            _, left, middle, right = heapq.heappop(agenda)
            if not alive[left] or end[left] != middle or middle >= size or not alive[middle] or end[middle] != right:
                continue  # one of the two has been merged since
            number += 1
            if limit and decision(key, number - 1) < limit:
                continue
            alive[middle], end[left] = False, right
            after[left] = after[middle]
            if after[left] < size:
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [word[k: end[k]] for k in range(size) if alive[k]]

    def word_ids(self, word: str, key: int, dropout: float) -> bytes:
        return self._spelt(self.merged(word, key, dropout))

    def _spelt(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for piece in pieces:
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
        return np.array(out, "<u4").tobytes()

    def many_ids(self, words: list[str], keys: np.ndarray, dropout: float) -> tuple[list[bytes], np.ndarray]:
        """The ids of words, each under its key, as ``word_ids`` gives them one by one, and how
        many candidates each agenda brought up (more than ``DRAWN`` for those with an agenda each)."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.full(len(words), DRAWN + 1, np.int64)
        for low, width in zip((0, *WIDTHS), WIDTHS):
            places = np.flatnonzero((sizes > low) & (sizes <= width))
            for begin in range(0, len(places), CELLS // width):
                some = places[begin: begin + CELLS // width]
                found, numbers[some] = self._side_by_side([words[k] for k in some.tolist()], keys[some], sizes[some], width, dropout)
                for k, ids in zip(some.tolist(), found):
                    out[k] = ids
        for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[k] = self.word_ids(words[k], int(keys[k]), dropout)
        return out, numbers

    def _side_by_side(self, words: list[str], keys: np.ndarray, sizes: np.ndarray, width: int,
                      dropout: float) -> tuple[list[bytes], np.ndarray]:
        n, limit = len(words), skip_limit(dropout)
        columns = np.arange(width)
        alive = columns < sizes[:, None]
        symbols = np.full((n, width + 1), self.other, np.int32)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols[:, :width][alive] = self.of_char[chars]
        # The part at a place starts there; its neighbours are found by their own places.
        after = np.tile(np.arange(1, width + 3, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (n, 1))
        agenda = np.full((n, width), -np.inf, np.float32)
        whole = np.zeros((n, width), np.int32)
        agenda[:, :-1], whole[:, :-1] = self._joined(symbols[:, : width - 1], symbols[:, 1:width])
        rows, number, numbers = np.arange(n), 0, np.zeros(n, np.int64)
        while True:
            left = agenda[rows].argmax(1)
            some = agenda[rows, left] > -np.inf
            rows, left = rows[some], left[some]
            if not len(rows):
                break
            middle = after[rows, left]
            right = after[rows, middle]
            number += 1
            numbers[rows] = number
            if limit:
                skip = decision(keys[rows], number - 1) < limit
                agenda[rows[skip], left[skip]] = -np.inf
                r, left, middle, right = rows[~skip], left[~skip], middle[~skip], right[~skip]
            else:
                r = rows
            symbols[r, left] = whole[r, left]
            alive[r, middle] = False
            agenda[r, middle] = -np.inf
            after[r, left], before[r, right] = right, left
            # A part that ends its word meets the padding, which joins with nothing.
            agenda[r, left], whole[r, left] = self._joined(symbols[r, left], symbols[r, np.minimum(right, width)])
            previous = before[r, left]
            r, left, previous = r[previous >= 0], left[previous >= 0], previous[previous >= 0]
            agenda[r, previous], whole[r, previous] = self._joined(symbols[r, previous], symbols[r, left])
        kept = symbols[:, :width][alive]
        ends = np.cumsum(alive.sum(1))
        spelt = kept >= self.n_pieces
        flat = self.piece_ids[np.where(spelt, 0, kept)].tobytes()
        cuts = [0, *(ends * 4).tolist()]
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(spelt), side="right")).tolist():
            starts = [*np.flatnonzero(alive[k]).tolist(), int(sizes[k])]
            out[k] = self._spelt([words[k][a:b] for a, b in zip(starts, starts[1:])])
        return out, numbers

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that every encoding puts in front is taken off."""
        return self.model.decode(ids)


def skip_limit(dropout: float) -> int:
    """Decisions under this skip a merge; they are numbers of 16 bits."""
    return round(dropout * (1 << 16))


def _finished(z):
    """The bits of a number mixed: of one of 64 bits, or of an array of unsigned ones."""
    if isinstance(z, int):
        z &= ALL_BITS
        for shift, factor in zip((30, 27), FINISH):
            z = (z ^ (z >> shift)) * factor & ALL_BITS
        return z ^ (z >> 31)
    for shift, factor in zip((30, 27), FINISH):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def decision(key, number: int):
    """16 bits for the candidate of that number under a key (or an array of keys)."""
    add = (number // 4) * SPREAD[1] & ALL_BITS
    if isinstance(key, int):
        return _finished(key + add) >> 16 * (number % 4) & 0xFFFF
    return (_finished(key + np.uint64(add)) >> np.uint64(16 * (number % 4))) & np.uint64(0xFFFF)


def place_keys(seed: int, key: object, places: np.ndarray) -> np.ndarray:
    """A key for every place of a word in the document with ``key``."""
    start = np.uint64(xxhash.xxh3_64_intdigest(f"{seed}\0{key}"))
    return _finished(start + places.astype(np.uint64) * np.uint64(SPREAD[0]))


def drawn(keys: np.ndarray, dropout: float) -> np.ndarray:
    """The first ``DRAWN`` decisions of each key as bits, the first one lowest; 1 skips."""
    limit, bits = np.uint64(skip_limit(dropout)), np.zeros(len(keys), np.int64)
    for four in range(DRAWN // 4):
        z = _finished(keys + np.uint64(four * SPREAD[1] & ALL_BITS))
        for k in range(4):
            bits |= (((z >> np.uint64(16 * k)) & np.uint64(0xFFFF)) < limit).astype(np.int64) << (4 * four + k)
    return bits


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def words_of(text: str) -> list[str]:
    """The words of a text, escaped; one that holds the space mark itself has its own spaces
    in front and is spelt in bytes, since its merged pieces would not come back."""
    if SPACE not in text:
        return WORD.findall(escaped(text))
    return [w if SPACE in w else w.replace(" ", SPACE) for w in RAW_WORD.findall(" " + text)]


class DropoutEncoder:
    """Encodes whole texts word by word; every place of a word draws its own decisions.

    A word's cut follows from the decisions that its agenda asked for. Cuts are remembered by
    word and those decisions, so an agenda is only run again where a place's decisions lead to
    a cut that is not known yet.
    """

    def __init__(self, path: str, seed: int, dropout: float) -> None:
        self.model, self.seed, self.dropout = PieceModel(path), seed, dropout
        # By word: how many decisions its cuts took, and the cuts by those decisions, with a
        # bit above them for their number.
        self.held: dict[str, tuple[list[int], dict[int, bytes]]] = {}
        self.cuts = 0

    def ids(self, key: object, text: str | None) -> bytes:
        return b"" if text is None else next(self.all_ids([key], [text]))

    def all_ids(self, keys: list[object], texts: list[str | None]) -> Iterator[bytes | None]:
        """The ids of each text in turn; a null text has null ids."""
        at = 0
        while at < len(texts):
            begin, chars = at, 0
            while at < len(texts) and (at == begin or chars + len(texts[at] or "") <= BLOCK_CHARS):
                chars += len(texts[at] or "")
                at += 1
            yield from self._block(keys[begin:at], texts[begin:at])

    def _block(self, keys: list[object], texts: list[str | None]) -> Iterator[bytes | None]:
        cut = [words_of(t) if t else () for t in texts]
        words = [w for listed in cut for w in listed]
        places = [place_keys(self.seed, k, np.arange(len(listed))) for k, listed in zip(keys, cut)]
        places = np.concatenate(places) if places else np.empty(0, np.uint64)
        bits = (drawn(places, self.dropout) if self.dropout else np.zeros(len(words), np.int64)).tolist()
        found: list[bytes | None] = [None] * len(words)
        left = self._looked_up(range(len(words)), words, bits, found)
        while left:
            left = self._run(left, words, places, bits, found)
        at = 0
        for text, listed in zip(texts, cut):
            yield None if text is None else b"".join(found[at: at + len(listed)])
            at += len(listed)
        if self.cuts > CUTS_HELD:
            self.held = dict(islice(self.held.items(), len(self.held) // 2))
            self.cuts = sum(len(c) for _, c in self.held.values())

    def _looked_up(self, places: Iterable[int], words: list[str], bits: list[int], found: list[bytes | None]) -> list[int]:
        """Fills in the cuts that are known; the places without one."""
        held, left = self.held, []
        for k in places:
            known = held.get(words[k])
            if known is not None:
                b, cuts = bits[k], known[1]
                for n in known[0]:
                    code = b & LOW[n] | BIT[n]
                    if code in cuts:
                        found[k] = cuts[code]
                        break
                else:
                    left.append(k)
            else:
                left.append(k)
        return left

    def _run(self, left: list[int], words: list[str], places: np.ndarray, bits: list[int],
             found: list[bytes | None]) -> list[int]:
        """Agendas for one place of each word and beginning of decisions; the places still without a cut."""
        held, first, more = self.held, {}, []
        for k in left:
            word = words[k]
            known = held.get(word)
            if known is not None:
                # Places whose first decisions are alike mostly have the same cut.
                if first.setdefault((word, bits[k] & LOW[min(DRAWN, known[0][0] + 2)]), k) != k:
                    more.append(k)
            elif word.startswith(" "):
                found[k] = self._spelt(word)
            elif len(word) > LONGEST_HELD:
                first[k] = k
            elif first.setdefault(word, k) != k:
                more.append(k)
        some = list(first.values())
        ids, numbers = self.model.many_ids([words[k] for k in some], places[some], self.dropout)
        for k, own, n in zip(some, ids, numbers.tolist()):
            word, found[k] = words[k], own
            if n <= DRAWN and len(word) <= LONGEST_HELD:
                known = held.get(word)
                if known is None:
                    held[word] = ([n], {bits[k] & LOW[n] | BIT[n]: own})
                else:
                    if n not in known[0]:
                        known[0].append(n)
                    known[1][bits[k] & LOW[n] | BIT[n]] = own
                self.cuts += 1
        return self._looked_up(more, words, bits, found)

    def _spelt(self, word: str) -> bytes:
        bare = word.lstrip(" ")
        ids = [self.model.ids[SPACE]] * (len(word) - len(bare)) + [self.model.bytes[b] for b in bare.encode()]
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist()) if ids else ""


@functools.lru_cache(maxsize=2)
def encoder(path: str, seed: int, dropout: float) -> DropoutEncoder:
    return DropoutEncoder(path, seed, dropout)


def encoded(docs: DataFrame, path: str = PIECE_BPE, seed: int = SEED, dropout: float = DROPOUT,
            doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian 32-bit) of every document.

    Which merges are skipped follows from the seed, the document's id, the place of the word
    in its text and the number of the candidate, so a word is cut in several ways within a
    text, and a run that is repeated cuts it alike. A null text has null ids, an empty one
    none. Nothing is shuffled.
    """
    @shared.trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, seed, dropout)
        # Encoding makes no reference cycles; the collector would walk all remembered cuts
        # again and again.
        gc.disable()
        try:
            for batch in batches:
                ids = list(of.all_ids(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        finally:
            gc.enable()

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(cut, f"doc_id {kind}, ids binary")


def decoded(rows: DataFrame, path: str = PIECE_BPE) -> DataFrame:
    """The rows of ``encoded`` with their ``text`` again; null ids give a null text."""
    @shared.trimmed
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, SEED, 0.0)
        for batch in batches:
            texts = [None if x is None else of.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(read, f"{schema}, text string")


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with dropout and decoded again: counts and checksums of both."""
    return decoded(encoded(shared.table(spark, sf_dir, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"), F.char_length("text").cast("long").alias("decoded_chars"),
        F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))
