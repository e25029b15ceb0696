"""Spelling variants against plain Python over all pairs that can be near."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfcast.llm import spelling

SF = "/root/testdata/sf0.001"


def counted(rows, damage=31, least=7):
    """Words by the definition: every run on its own, in its own document."""
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def expected(words, ratio=10):
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1:], i].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= ratio * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def read(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(counted(rows))
    assert sum(1 for r in want if r[4]) > 50
    assert read(spelling.op11_spelling_variants(spark, SF)) == want


def some_words(seed, n):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abé"), rng.integers(7, 12))) for _ in range(n)]
    base += ["a" * k for k in range(7, 14)] + ["a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150]
    return {w: int(rng.choice([2, 3, 25, 260, 2700])) for w in base}


@pytest.mark.parametrize("limits", [{}, {"BLOCK_WORDS": 64, "QUERIES": 16, "HOT_WORDS": 8, "HOT_SHARE": 0}])
def test_dense_vocabulary_in_one_or_many_blocks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    words = some_words(3, 700)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = expected(words)
    assert any(r[1] and r[2] != r[1] for r in want)
    assert read(spelling.variants(frame)) == want


def test_index_ranks_agree_with_counting():
    words = sorted(w.encode("latin-1") for w in some_words(5, 60))
    index = spelling.SuffixRanks(words)
    whole = b"\0" + b"\0".join(words) + b"\0"
    for part in [b"a", b"ab", b"ba\xe9", b"aaaaaaa", b"\xe9\xe9", b"c"]:
        low, high = np.zeros(1, np.int64), np.array([index.delimiters])
        for code in reversed(part):
            low, high = index.step(np.array([code]), low), index.step(np.array([code]), high)
        ending = sum(w.endswith(part) for w in words)
        assert max(0, int(high[0] - low[0])) == ending, part
    assert whole.count(0) == index.delimiters


def test_odd_documents(spark):
    schema = "doc_id long, text string, word string, n string"
    rows = [(1, None), (2, ""), (3, "Straßenbau straßenbau STRASSENBAU"), (None, "xcolour colours Colours"), (4, "colours, colours"),
            (4, "colours, colours"), (5, "ab" * 3_000), (6, "ab" * 3_000), (7, "résumés×résumés÷ 日本日本日本日本"), (8, "résumés×résumés÷")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], schema)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == counted(rows)
    assert read(spelling.variants(spelling.word_counts(docs))) == expected(counted(rows))
    assert spelling.variants(spelling.word_counts(docs.filter("doc_id < 0"))).count() == 0
    plain = spelling.Rules(damage=0, least_count=1)
    assert {r.word for r in spelling.word_counts(docs.filter("doc_id = 4"), plain).collect()} == {"colours"}
