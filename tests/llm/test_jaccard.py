"""The n-gram join against all pairs, with its limits lowered so that every branch runs."""

import os

import numpy as np
import pytest

from shelfcast.llm import jaccard

SF = "/root/testdata/sf0.001"


def expected(rows, n=4, percent=85):
    """(id, set size, component) by comparing all pairs of documents."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i: i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    up = {k: k for k, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = root(a), root(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted((k, len(s), root(k)) for (k, _), s in zip(rows, sets))


def texts():
    """Near copies of a few texts, chains of them, texts that share much but not enough, and odd ones."""
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 4000, 120)] for _ in range(3)]
    out = []
    for k in range(90):
        words = list(base[k % 3])
        for _ in range(rng.integers(0, 4 if k % 3 else 9)):
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 40)}"
        out.append(" ".join(words))
    chain = [f"c{i}" for i in range(200)]
    out += [" ".join(chain[k: k + 120]) for k in range(0, 60, 4)]
    out += [" ".join(base[0][:60] + [f"y{k}_{i}" for i in range(60)]) for k in range(12)]
    return out + ["", None, "one", "ONE", "one two", base[0][0], " ".join(base[1]).upper()]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_NGRAMS": 700}, {"BLOCK_NGRAMS": 300, "SENT_ROWS": -1}])
def test_components_equal_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = [(k * 3, t) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == expected(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in jaccard.op9_ngram_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect())
    assert got == expected(rows)
