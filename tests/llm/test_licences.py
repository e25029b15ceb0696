"""Licence scans against plain searches, and templates that share runs."""

import os
import re

import numpy as np
import pytest

from shelfcast.llm import licences

SF = "/root/testdata/sf0.01"


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def base(text):
    words = words_of(text)
    found = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words))
             if words[i: i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_base_columns_equal_a_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = licences.op8_licence_automaton(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id]), r.doc_id
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.score == 1 or not r.base_labels
    assert sum(r.n_base > 0 for r in rows) > 0


def test_every_template_names_itself_wherever_it_stands():
    scan = licences.scanner()
    for label, text in licences.TEMPLATES.items():
        found = scan.scan(f"some words before {text.title()}; and some behind")
        assert label in found["labels"].split(","), label
        span = next(s for s in found["spans"] if s[0] == label)
        assert span[1:3] == (3, 3 + len(words_of(text))) and span[3] == 1 and found["score"] == 1


def test_a_longer_run_of_another_template_hides_nothing():
    scan = licences.scanner({"s": "a b c d e f g h", "t": "e f g h i j k l m n"}, {"no such": "x"})
    for text in ("e f g h x i j k l m n", "a b c d e f g h x i j k l m n", "a b c d e f g h i j k l m n"):
        found = {s[0]: s for s in scan.scan(text)["spans"]}
        assert found["t"][3] == 1, text
    both = scan.scan("a b c d e f g h x i j k l m n")
    assert both["labels"] == "s,t" and dict((s[0], s[1:3]) for s in both["spans"]) == {"s": (0, 8), "t": (4, 15)}


def test_chains_cover_no_more_than_the_texts_share():
    """Against the longest common subsequence, which no chain of runs can exceed."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        template = [f"w{k}" for k in rng.integers(0, 12, 20)]
        text = list(template)
        for _ in range(rng.integers(0, 5)):
            at = rng.integers(0, len(text))
            text[at: at + rng.integers(0, 3)] = [f"w{k}" for k in rng.integers(0, 12, rng.integers(0, 3))]
        scan = licences.scanner({"t": " ".join(template)}, {"no such": "x"}, least_run=2)
        table = np.zeros((len(text) + 1, 21), int)
        for i, a in enumerate(text):
            for j, b in enumerate(template):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        score = scan.scan(" ".join(text))["score"]
        assert score * 20 <= table[-1, -1] + 1e-9
        if text == template:
            assert score == 1


def test_odd_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "MIT License", 1), (3, "mit\nLICENSE " * 5000, 5000), (4, "é mit license", 1)]
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, _ in rows], "doc_id long, text string, labels string, score double")
    got = sorted(((r.doc_id, r.n_base) for r in licences.licence_report(docs).collect()), key=repr)
    assert got == sorted(((k, n) for k, _, n in rows), key=repr)
    assert licences.licence_report(docs.filter("doc_id > 9")).count() == 0
