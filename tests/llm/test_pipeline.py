"""The corpus pipeline against brute force on the smallest tables."""

import collections
import os

import pytest

import corpus_pipeline
from shelfcast.llm import packing, repetition, surrogates

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)}


def smallest_of_each(texts):
    """The smallest id of every component, by comparing all pairs."""
    sets, up = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k for k in keys if root(k) == k}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_pipeline_keeps_and_packs_what_brute_force_keeps(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdicts = repetition._metrics(list(docs.values()), repetition.Rules())
    kept = {k: t for (k, t), v in zip(docs.items(), verdicts) if v[6]}
    kept = {k: kept[k] for k in smallest_of_each(kept)}
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    clean = surrogates.with_surrogates(frame)
    want = collections.Counter(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.document_pieces(clean).collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= packing.CAPACITY
