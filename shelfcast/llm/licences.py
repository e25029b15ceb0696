"""Licence scan: matching statistics of texts against a suffix automaton of licence templates.

The automaton accepts every run of words of every template. A text is streamed through it
word by word; after each word its state tells the longest run of words ending there that
occurs in some template, and where. Long runs are chained, in order within a template, into
covered spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Public licence notices, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0 the license you may not use this file except in "
    "compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
    "specific language governing permissions and limitations under the license",
    "apache-notice": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
    "public license for more details",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software the software is provided as is without warranty of any kind express or implied",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl "
    "was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
    "mit-whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software the software is provided as is without warranty of any kind express or implied including but not limited "
    "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
    "authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the "
    "software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
    "provided as is and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect "
    "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
    "of contract negligence or other tortious action arising out of or in connection with the use or performance of "
    "this software",
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted the software is provided as is and the author disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met 1 redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the "
    "above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution this software is provided by the copyright holders and contributors as is "
    "and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable "
    "for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-no-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be "
    "held liable for any damages arising from the use of this software permission is granted to anyone to use this "
    "software for any purpose including commercial applications and to alter it and redistribute it freely subject to "
    "the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you "
    "wrote the original software if you use this software in a product an acknowledgment in the product documentation "
    "would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be "
    "misrepresented as being the original software 3 this notice may not be removed or altered from any source "
    "distribution",
    "boost-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
    "software and accompanying documentation covered by this license the software to use reproduce display distribute "
    "execute and transmit the software and to prepare derivative works of the software and to permit third parties to "
    "whom the software is furnished to do so all subject to the following",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify "
    "publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
    "purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu "
    "lesser general public license as published by the free software foundation either version 2.1 of the license or at "
    "your option any later version this library is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "lesser general public license for more details",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "affero general public license as published by the free software foundation either version 3 of the license or at "
    "your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "affero general public license for more details",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse "
    "public license 2.0 which is available at",
    "postgresql": "permission to use copy modify and distribute this software and its documentation for any purpose "
    "without fee and without a written agreement is hereby granted provided that the above copyright notice and this "
    "paragraph and the following two paragraphs appear in all copies",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
    "this work",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-notice": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-nc-notice": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
}
# A run counts from so many words, or from the whole of a shorter template.
LEAST_RUN = 4
# Two runs of a chain may lie so many words apart, in the text and in the template.
LONGEST_GAP = 8
# A template is named when its best chain covers this share of it.
LEAST_COVER = 0.8
# ASCII letters and digits, letters lower-cased; everything else in ASCII parts words.
WORD_BYTES = bytes(
    b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """Generalised suffix automaton: per state its longest run, suffix link and arcs.

    ``ends`` has, for each state, the templates in which its runs end: (template, place of the
    last word). A state's own places are those of its longest run; the places at which only a
    shorter run with the same end stands are found along the suffix links. ``phrases`` has the
    phrases that end a state's runs.
    """

    size: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    arcs: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    credits: list[list[tuple[int, int, int]]] = field(default_factory=list)
    phrases: list[tuple[tuple[int, int], ...]] = field(default_factory=list)

    def _state(self, size: int, link: int, arcs: dict[bytes, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.arcs.append(dict(arcs))
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, above: int, word: bytes, below: int) -> int:
        """A state for the runs of ``below`` that are as short as ``above`` and a word."""
        copy = self._state(self.size[above] + 1, self.link[below], self.arcs[below])
        self.link[below] = copy
        while above >= 0 and self.arcs[above].get(word) == below:
            self.arcs[above][word] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        there = self.arcs[last].get(word)
        if there is not None:
            return there if self.size[there] == self.size[last] + 1 else self._split(last, word, there)
        new, at = self._state(self.size[last] + 1, 0, {}), last
        while at >= 0 and word not in self.arcs[at]:
            self.arcs[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.arcs[at][word]
            self.link[new] = there if self.size[there] == self.size[at] + 1 else self._split(at, word, there)
        return new

    @classmethod
    def of(cls, templates: list[list[bytes]], phrases: list[list[bytes]]) -> "Automaton":
        found = cls()
        for words in [*templates, *phrases]:
            last = 0
            for word in words:
                last = found._extend(last, word)
        for t, words in enumerate(templates):
            at = 0
            for place, word in enumerate(words):
                at = found.arcs[at][word]
                found.ends[at].add((t, place))
        # A run ends wherever a longer run with it as a suffix ends.
        for at in sorted(range(1, len(found.size)), key=found.size.__getitem__, reverse=True):
            if found.link[at] > 0:
                found.ends[found.link[at]] |= found.ends[at]
        # Along the links: where shorter runs end that the longer ones do not.
        found.credits = [[] for _ in found.size]
        for at in range(1, len(found.size)):
            seen: set[tuple[int, int]] = set()
            up = at
            while up > 0:
                found.credits[at] += [(t, place, found.size[up]) for t, place in sorted(found.ends[up] - seen)]
                seen |= found.ends[up]
                up = found.link[up]
        whole = {}
        for p, words in enumerate(phrases):
            at = 0
            for word in words:
                at = found.arcs[at][word]
            whole.setdefault(at, []).append((p, len(words)))
        for at in range(len(found.size)):
            marks, up = [], at
            while up > 0:
                marks += whole.get(up, [])
                up = found.link[up]
            found.phrases.append(tuple(marks))
        return found

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of matching statistics over one word that end at a place."""
        at, n, arcs, link, size = 0, 0, self.arcs, self.link, self.size
        first = arcs[0]
        for place, word in enumerate(words):
            if not at and word not in first:
                continue
            while at and word not in arcs[at]:
                at = link[at]
                n = size[at]
            then = arcs[at].get(word)
            if then is None:
                n = 0
                continue
            at, n = then, n + 1
            if n > 1:
                yield place, n, at


@dataclass(frozen=True)
class Scanner:
    """The automaton with its templates; built once and sent to the tasks."""

    labels: tuple[str, ...]
    sizes: tuple[int, ...]
    phrase_labels: tuple[str, ...]
    automaton: Automaton
    least_run: int
    longest_gap: int
    least_cover: float

    def scan(self, text: str | None) -> dict:
        """Places of phrases, best chain per template, labels and score of one text."""
        words = words_of(text)
        auto, hits, long_runs = self.automaton, [], []
        before = None
        for place, n, state in auto.runs(words):
            for phrase, size in auto.phrases[state]:
                if n >= size:
                    hits.append((place - size + 1, phrase))
            # A run is whole once the next word does not lengthen it.
            if before and (place != before[0] + 1 or n != before[1] + 1):
                long_runs.append(before)
            before = (place, n, state)
        if before:
            long_runs.append(before)
        cover, spans = {}, []
        for label, (words_in, start, end) in self._chains(long_runs).items():
            share = words_in / self.sizes[label]
            cover[label] = share
            if share >= self.least_cover:
                spans.append((self.labels[label], start, end, share))
        base = sorted({self.phrase_labels[p] for _, p in hits})
        places = [at for at, _ in hits]
        return {
            "n_words": len(words), "n_base": len(hits),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *[s[0] for s in spans]})),
            "score": max([*cover.values(), 1.0 if hits else 0.0], default=0.0),
            "spans": sorted(spans),
        }

    def _chains(self, runs: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """Per template the chain of runs, in order in both, that covers most of its words.

        A run counts for every template that holds it or an end of it, with the length that the
        template holds. Runs may overlap, in the text or in the template; a chain takes of the
        later one what lies behind the earlier. Chains are grown from left to right. Only
        chains whose last run lies within the gap can be continued, so few are open at a time.
        """
        best: dict[int, tuple[int, int, int]] = {}
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        least = min(self.least_run, min(self.sizes))
        for place, n, state in runs:
            if n < least:
                continue
            for t, last, longest in self.automaton.credits[state]:
                own = min(n, longest)
                if own < min(self.least_run, self.sizes[t]):
                    continue
                start, from_ = place - own + 1, last - own + 1
                near = [c for c in open_.get(t, []) if start - c[0] <= self.longest_gap + 1]
                words_in, begin = own, start
                for end, to, covered, first in near:
                    if end < place and to < last and from_ <= to + self.longest_gap + 1:
                        more = min(own, place - end, last - to)
                        if covered + more > words_in:
                            words_in, begin = covered + more, first
                open_[t] = [*near, (place, last, words_in, begin)]
                if words_in > best.get(t, (0, 0, 0))[0]:
                    best[t] = (words_in, begin, place + 1)
        return best


def scanner(
    templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, least_run: int = LEAST_RUN,
    longest_gap: int = LONGEST_GAP, least_cover: float = LEAST_COVER,
) -> Scanner:
    cut = {k: words_of(v) for k, v in templates.items()}
    found = Automaton.of([*cut.values()], [*map(words_of, phrases)])
    return Scanner(tuple(cut), tuple(map(len, cut.values())), tuple(phrases.values()), found,
                   least_run, longest_gap, least_cover)


REPORT = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
}
SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
SCHEMA = ("doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,cover:double>>")


def licence_report(docs: DataFrame, found: Scanner | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document; ``spans`` are word spans (end not included) of covered templates.

    A null or empty text has no words, no places, empty labels and score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(found or scanner())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for batch in batches:
            rows = [of.scan(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in REPORT.items()]
            spans = pa.array([[dict(zip(("label", "start", "end", "cover"), s)) for s in r["spans"]] for r in rows], SPAN)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, spans], ["doc_id", *REPORT, "spans"])

    return docs.select(doc, text).mapInArrow(scan, SCHEMA.format(id=docs.schema[doc].dataType.simpleString()))


def op8_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence report of every document; nulls, empty and repeated rows as ``licence_report`` says."""
    return licence_report(shared.table(spark, sf_dir, "documents")).drop("spans")
