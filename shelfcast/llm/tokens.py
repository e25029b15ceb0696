"""Token ids of whole texts, encoded word by word with a bounded memory of words."""

from __future__ import annotations

import functools
import re
from itertools import islice

import numpy as np
import public_tokenizers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# Python counts these four as white space, the tokenizer's expressions do not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
WORDS_HELD = 150_000
PARTS_HELD = 400_000
LONGEST_HELD = 64
# What the splitter keeps together among letters that normalisation only lower-cases: runs of
# letters, single digits, runs of marks. Apostrophes start rules of their own and are left out.
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte, as a translation."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Held(dict):
    """Found values by key; long keys are not kept."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= LONGEST_HELD:
            self[key] = found
        return found

    def shrunk(self, limit: int) -> "_Held":
        """Itself, or past the limit the half that came first, which holds the common keys."""
        if len(self) <= limit:
            return self
        kept = _Held(self.find)
        kept.update(islice(self.items(), limit // 2))
        return kept


class WordTokens:
    """Ids as little-endian 32-bit bytes.

    The tokenizer drops white space before it splits a text, none of its tokens spans white
    space, and its normaliser joins nothing across it; so a text's ids are those of its
    words in order. Likewise the parts of a word are split before merging. Words and parts
    that come again are not encoded again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in self.added):
            raise ValueError("an added token spans white space; words cannot be encoded one by one")
        self.plain_added = any(t.isalpha() for t in self.added)
        self.merge = self.model.model.tokenize
        self.size = self.model.get_vocab_size()
        self.letters = _byte_letters()
        self.words, self.parts = _Held(self._word), _Held(self._part)

    def encode(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(spelt)])

    def _word(self, word: str) -> bytes:
        lower = word.lower()
        if lower.isascii() and lower.isalpha() and not self.plain_added:
            return self.parts[lower]
        parts = PARTS.findall(lower)
        # Added tokens are looked for in the word as it is written.
        if not len("".join(parts)) == len(lower) == len(word) or any([t in word for t in self.added]):
            return self.encode(word)
        return b"".join(map(self.parts.__getitem__, parts))

    def ids(self, text: str | None) -> bytes:
        """All ids of a text; a null text has none."""
        if not text:
            return b""
        if any(s in text for s in SEPARATORS):
            return self.encode(text)
        found = b"".join(map(self.words.__getitem__, text.split()))
        self.words, self.parts = self.words.shrunk(WORDS_HELD), self.parts.shrunk(PARTS_HELD)
        return found


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
