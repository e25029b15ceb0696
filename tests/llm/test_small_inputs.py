"""Odd inputs and brute-force results of the text operators."""

import collections
import hashlib
import base64
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfcast.llm import (
    components, jaccard, licences, packing, pieces, rans, repetition, shared, surrogates, tokens, urlrules, vafile, warc)

DOCS = "doc_id long, text string, lang string, kept boolean, n_words string, _entities string"
LONG = " ".join(f"w{i % 7919}" for i in range(30_000))
BASE = " ".join(f"t{i}" for i in range(200))
NEAR = BASE.replace("t100 ", "x ")
TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, BASE), (7, NEAR), (8, BASE), (8, BASE),
    (9, LONG), (10, "Mail a.b9@mail.example.org, A.B9@MAIL.example.org or +1 (017) 555-7713 and 4111111111111111!"),
    (11, 'Mr. John Smith met Frau Smith; token = "abcdef0123456789abcdef0123456789" 10.1.2.3'),
    (None, "no id"), (12, BASE[:400]), (13, "Released under the MIT License.\nmit license"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", True, "x", "y") for k, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def model_ids(text):
    return Tokenizer.from_file(tokens.WORD_BPE).encode(text or "", add_special_tokens=False).ids + [1]


def test_words_encode_like_whole_texts():
    held = tokens.WordTokens(tokens.WORD_BPE)
    for text in ["Straße ΣΑΣ İ don't we'll 12,3 a\x1cb", "é́a ÀÉ!!! hello,world ..", "日本 x" * 40, "a<b>|c ###"]:
        assert held.ids(text) == held.encode(text)


def test_added_tokens_keep_their_ids():
    held = tokens.WordTokens(tokens.WORD_BPE)
    for text in ["end <|endoftext|> next", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> <|startoftext|>!! É\x1c<|endoftext|>"]:
        assert np.frombuffer(held.ids(text), "<u4").tolist() + [1] == model_ids(text)
    assert 49407 in np.frombuffer(held.ids("end <|endoftext|> next"), "<u4").tolist()


def test_pieces_of_documents_pack_without_gaps(docs, none):
    rows = packing.pack_documents(docs, capacity=64).collect()
    found = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = collections.Counter()
    for k, text in TEXTS:
        ids = model_ids(text)
        for at in range(0, len(ids), 64):
            part = np.array(ids[at: at + 64], "<u4")
            want[(k, at // 64, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert found == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]]
        assert sum(n for _, n in held) <= 64
    assert packing.pack_documents(none).count() == 0


def fewest(lengths, capacity):
    """Fewest bins by exhaustive search."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[k] and room not in rooms[:i]:
                put(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1:]])
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best


def test_reduction_keeps_an_optimal_packing():
    rng = np.random.default_rng(7)
    for _ in range(150):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        fixed, rest = packing.reduced(dict(collections.Counter(lengths)), 20)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(sorted(left, reverse=True), 20) == fewest(lengths, 20)
        assert sum(n for _, n in fixed + packing.best_fit(rest, 20)) >= fewest(lengths, 20)


def test_coded_files_round_trip(spark, docs, none, tmp_path):
    for frame, name in ((docs, "a"), (none, "b")):
        rows = rans.token_rows(frame, tokens.WORD_BPE, 1, "doc_id", "text")
        table = rans.write_coded(rows, str(tmp_path / name), rans.id_type(tokens.WORD_BPE), shard_ids=500)
        read = rans.read_coded(spark, str(tmp_path / name), table).collect() if name == "a" else []
        got = collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in read)
        want = collections.Counter()
        for k, text in TEXTS if name == "a" else []:
            ids = np.array(model_ids(text), "<u4")
            want[(k, len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert got == want


def test_any_block_decodes_alone_and_damage_shows():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 3_000_000).clip(0, 49_000).astype("<u4")
    counts = np.bincount(ids)
    table = rans.FrequencyTable(np.flatnonzero(counts), counts[np.flatnonzero(counts)])
    data = b"".join(rans.encode_file([(5, ids[:10]), (7, ids[10:])], table))
    coded = rans.CodedFile(data + b"\0", table)
    assert len(coded.checkpoints) == 3
    assert (coded.block(2) == ids[2 * rans.BLOCK_IDS:]).all()
    assert (coded.ids(1_500_000, 900_000) == ids[1_500_000:2_400_000]).all()
    broken = bytearray(data)
    broken[coded.checkpoints[1][0] + 40_000] ^= 1
    with pytest.raises(ValueError):
        rans.CodedFile(bytes(broken), table).block(1)


def brute_repeats(words, least):
    """Longest repeat from each position, by comparing all pairs."""
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= least:
                out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def test_longest_repeats_equal_brute_force():
    rng = np.random.default_rng(3)
    for least in (1, 2, 3, 5, 8):
        for _ in range(20):
            texts = [rng.integers(0, rng.integers(2, 5), rng.integers(0, 50)) for _ in range(3)]
            ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
            key = np.concatenate([t + 10 * k for k, t in enumerate(texts)]).astype(np.int64)
            got = repetition.longest_repeats(key, ends, least)
            assert got.tolist() == [x for t in texts for x in brute_repeats(t.tolist(), least)]


def test_repetition_of_odd_texts(docs, none):
    rows = {r.doc_id: r for r in repetition.repetition_report(docs).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[9].n_words == 30_000 and rows[9].longest_repeat == 30_000 - 7919
    assert rows[6].kept and rows[6].n_repeat_words == 0
    kept = repetition.quality_kept(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {6, 7, 8, 12}
    assert repetition.quality_kept(none).count() == 0 and repetition.repetition_report(none).count() == 0


def test_jaccard_components(docs, none):
    rows = sorted(jaccard.similar_documents(docs).collect(), key=repr)
    assert {(r.doc_id, r.component_id) for r in rows} == {
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 9), (10, 10), (11, 11), (None, None), (12, 12), (13, 13)}
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0} and len(rows) == len(TEXTS)
    assert jaccard.similar_documents(none).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(docs).collect()) == [0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 13]


def test_block_links_connect_what_all_pairs_connect():
    rng, join = np.random.default_rng(5), jaccard.Join()
    base = [rng.integers(0, 1 << 40, 60) for _ in range(4)]
    rows = []
    for k in range(120):
        one = base[k % 4].copy()
        one[rng.choice(60, rng.integers(0, 5), replace=False)] = rng.integers(0, 1 << 40)
        rows.append((k, np.unique(one)))

    def groups(pairs):
        forest = jaccard._Forest()
        for u, v in pairs:
            forest.joined(u, v)
        return [forest.root(k) for k in range(120)]

    every = [(a, b) for a, x in rows for b, y in rows if a < b and join.linked(
        np.array([len(np.intersect1d(x, y))]), len(x), np.array([len(y)]))[0]]
    assert groups(jaccard.block_links(rows, [], join, False)) == groups(every)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(50, 40), (7, 7)], "u long, v long")
    found = dict(components.components(edges).collect())
    assert found == {**{k: 0 for k in range(21)}, 40: 40, 50: 40}


def test_surrogates(docs, none):
    rows = {r.doc_id: r for r in surrogates.with_surrogates(docs, entities="found").collect()}
    assert rows[10].found[0] == "a.b9@mail.example.org" and rows[1].found == []
    mail = rows[10].text
    assert "4111111111111111" not in mail and "555-7713" not in mail and "b9@" not in mail.lower()
    a, b = [w.rstrip(",") for w in mail.split() if "@" in w]
    assert a.lower() == b.lower()
    names = rows[11].text
    assert "Smith" not in names and "John" not in names and "10.1.2.3" not in names
    assert names.split()[2] == names.split(";")[0].split()[-1]
    assert names.split()[1].endswith("ton")
    for k in (1, 2, 3, 4, 6, 9):
        assert rows[k].text == dict(TEXTS)[k]
    assert surrogates.with_surrogates(none).count() == 0
    counted = surrogates.with_surrogates(docs.selectExpr("doc_id", "text", "2L * length(text) AS n_chars"), entities="found")
    for r in counted.filter("text IS NOT NULL").collect():
        assert r.n_chars == (len(r.text) if r.found else 2 * len(r.text))


def test_surrogates_leave_other_columns_as_they_are(spark, docs, monkeypatch):
    clashing = "doc_id long, text string, _entities string, attempts int, Entities int, names array<int>, some boolean, BODY long"
    rows = [(k, t, "mine", 1, 2, [3], True, 4) for k, t in TEXTS]
    frame = spark.createDataFrame(rows, clashing)
    for limit in (surrogates.MAP_ROWS, -1):
        monkeypatch.setattr(surrogates, "MAP_ROWS", limit)
        out = surrogates.with_surrogates(frame)
        assert out.columns == frame.columns
        assert all(tuple(r)[2:] == rows[0][2:] for r in out.collect())
    with pytest.raises(ValueError):
        surrogates.with_surrogates(frame, entities="ENTITIES")


def test_attempts_by_map_and_by_join_are_alike(spark, monkeypatch):
    texts = [f"call +{k} or Mr. John Smith" for k in range(10_000, 10_100)] + [None, "", "no entity", "call +10001"] * 2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_map = {r.doc_id: r.text for r in surrogates.with_surrogates(frame).collect()}
    assert surrogates.attempts_needed(frame, "text", surrogates.KEY).count() > 0
    monkeypatch.setattr(surrogates, "MAP_ROWS", -1)
    assert {r.doc_id: r.text for r in surrogates.with_surrogates(frame).collect()} == by_map


def surrogates_apart(spark, entities):
    """The surrogate of each entity, by texts of one entity; none is shared or an entity itself."""
    frame = spark.createDataFrame(list(enumerate(entities)), "doc_id long, text string")
    new = [r.text for r in sorted(surrogates.with_surrogates(frame).collect(), key=lambda r: r.doc_id)]
    assert len(set(new)) == len(set(entities)) and not set(new) & set(entities)
    return new


def test_surrogates_of_formats_with_few_values(spark):
    few = [f"+353{k:02d}" for k in range(100)] + [f"+{k}" for k in range(10_000, 10_100)]
    few += [f"{c}@busy.org" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    new = surrogates_apart(spark, [*few, "password: " + "_" * 16])
    assert all(n.startswith("+353") and n[1:].isdigit() for n in new[:100])
    assert all("@" in n for n in new[200:236])


def test_spellings_share_a_surrogate(spark):
    texts = ["+1 (017) 555-7713", "+10175557713", "+1 017-555-7713", "abe@x.org", "Abe@x.org", "ABE@X.org"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in sorted(surrogates.with_surrogates(frame).collect(), key=lambda r: r.doc_id)]
    assert len({"".join(c for c in n if c.isdigit()) for n in new[:3]}) == 1
    assert all(n.startswith("+1") and "017" not in n[:7] for n in new[:3])
    assert len({n.lower() for n in new[3:]}) == 1 and "abe" not in new[3]


def test_whole_names_and_their_repeats(spark):
    real = ["John", "Michael", "Smith", "Kennedy", "F.", "Tolkien", "Merkel", "Beethoven", "Jones", "SMITH", "Иванов"]
    texts = [
        "Mr. John Michael Smith met Mr. Smith; Smith's dog, SMITH and John left.", "Mr. John F. Kennedy and Kennedy",
        "Mr. J. Smith, Mr. J.R.R. Tolkien", "Dr. Merkel, Frau Prof. Dr. Merkel", "MR. JOHN SMITH", "Prof. Jones",
        "Herr Ludwig van Beethoven", "г-н Иванов И. И. и Иванов", "Mr.Smith Jr. was here", "Smith without title"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in sorted(surrogates.with_surrogates(frame).collect(), key=lambda r: r.doc_id)]
    assert new[-1] == texts[-1]
    assert not [(r, n) for r in real for n in new[:-1] if r in n]
    smith = new[0].split(" met ")[1].split(";")[0].split()[1]
    words = new[0].replace(";", " ").replace(",", " ").split()
    assert words[3] == smith == words[6] and words[7] == f"{smith}'s" and words[9] == smith.upper()
    assert words[1] == words[11] and new[0].endswith(" left.")
    assert new[2].split(",")[0].split()[-1] == smith and new[8] == f"Mr.{smith} Jr. was here"
    assert new[4].split()[-1] == smith.upper() and " van " in new[6]
    assert new[3].split(",")[0].split()[-1] == new[3].split()[-1]


def test_surrogates_of_more_names_than_four_syllables_make(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "LATIN", ["ba", "do"])
    letters = "abcdefghij"
    surrogates_apart(spark, [f"Mr. {a.upper()}{b}xx" for a in letters for b in letters])


def test_warc_round_trip(spark, tmp_path):
    big = "x" * (17 << 20)
    pages = spark.createDataFrame([
        (3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (9, "u", big), (None, "u", "q")],
        "page_id long, url string, html string")
    warc.write_monolithic(warc.with_revisits(pages, 0), str(tmp_path / "raw"))
    warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "out")).drop("block").collect()}
    kinds = {k: (r.record_type, r.refers_to) for k, r in got.items()}
    assert kinds == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2),
                     9: ("response", None), None: ("response", None)}
    assert got[9].payload_bytes == len(big) and got[3].payload_bytes == 4
    assert got[3].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()


def test_merge_dropout(docs):
    plain = pieces.DropoutEncoder(pieces.PIECE_BPE, 1, 0.0)
    for _, text in TEXTS:
        if text:
            assert np.frombuffer(plain.ids(1, text), "<u4").tolist() == plain.model.model.encode(text)
    rows = pieces.decoded(pieces.encoded(docs)).collect()
    assert sorted((r.text or "") for r in rows) == sorted((t or "") for _, t in TEXTS)
    cuts = {tuple(plain.model.merged("▁internationalization", v, 0.3)) for v in range(20)}
    assert len(cuts) > 3 and all("".join(c) == "▁internationalization" for c in cuts)


def test_words_merge_side_by_side_as_one_by_one():
    model = pieces.PieceModel(pieces.PIECE_BPE)
    words = [w for _, text in TEXTS if text for w in set(pieces.WORD.findall(pieces.escaped(text)))]
    words += ["▁", "▁▁▁", "🙂", "▁漢字🙂é", "\x00a" * 9, "▁" * 64, "ab" * 32, "ab" * 33, "▁internationalization"]
    words = [w for w in words if len(w) < 5000] * 3
    keys = pieces.place_keys(7, "doc", np.arange(len(words)))
    for dropout in (0.0, 0.1, 0.5, 1.0):
        assert model.many_ids(words, keys, dropout)[0] == [model.word_ids(w, int(k), dropout) for w, k in zip(words, keys)]


def one_by_one(model, key, text, seed, dropout):
    """A text's ids with an agenda for each place of a word."""
    out = []
    for place, word in enumerate(pieces.words_of(text) if text else ()):
        own = pieces.place_keys(seed, key, np.array([place]))[0]
        bare = word.lstrip(" ")
        out.append(model.word_ids(word, int(own), dropout) if bare == word else np.array(
            [model.ids["▁"]] * (len(word) - len(bare)) + [model.bytes[b] for b in bare.encode()], "<u4").tobytes())
    return b"".join(out)


@pytest.mark.parametrize("held, dropout", [(pieces.CUTS_HELD, 0.1), (50, 0.3), (pieces.CUTS_HELD, 1.0), (pieces.CUTS_HELD, 0.0)])
def test_remembered_cuts_are_those_of_every_place(monkeypatch, held, dropout):
    monkeypatch.setattr(pieces, "CUTS_HELD", held)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 3000)
    texts = [*TEXTS, (20, "internationalization of the internationalization " * 40), (20, "x" * 45 + " " + "x" * 45), (21, "a▁b of▁ it"),
             (22, "antidisestablishmentarianism " * 30)]
    many = pieces.DropoutEncoder(pieces.PIECE_BPE, 1, dropout)
    short = [(k, t if t is None else t[:20_000]) for k, t in texts]
    for _ in range(2):
        found = list(many.all_ids([k for k, _ in short], [t for _, t in short]))
        for (k, t), ids in zip(short, found):
            assert ids is None if t is None else ids == one_by_one(many.model, k, t, 1, dropout)
            assert t is None or many.decode(ids) == t


def test_a_word_is_cut_in_several_ways_within_a_text():
    many = pieces.DropoutEncoder(pieces.PIECE_BPE, 1, 0.1)
    word = "internationalization"
    cut = {many.model.word_ids("▁" + word, int(k), 0.1) for k in pieces.place_keys(1, 5, np.arange(400))}
    whole = many.ids(5, " ".join([word] * 400))
    assert len(cut) > 20 and whole == b"".join(
        many.model.word_ids("▁" + word, int(k), 0.1) for k in pieces.place_keys(1, 5, np.arange(400)))


def test_licences(docs, none):
    rows = {r.doc_id: r for r in licences.licence_report(docs).collect()}
    assert (rows[13].n_base, rows[13].first_word, rows[13].last_word, rows[13].labels) == (2, 3, 5, "mit,mit-notice")
    assert rows[1].n_words == 0 and rows[1].labels == "" and rows[1].score == 0
    assert licences.licence_report(none).count() == 0
    found = licences.scanner()
    text = "foo " + licences.TEMPLATES["mit-text"].replace("deal in", "trade in") + " bar"
    assert "mit-text" in found.scan(text)["labels"] and found.scan("permission is hereby refused")["labels"] == ""


def test_url_rules(spark):
    pages = spark.createDataFrame([
        (1, "http://WWW.Example.org/en/12?q"), (2, "http://example.org/en/2"), (3, "http://badexample.org/es/"),
        (4, "https://a.com/de/x"), (5, "https://a.com/fr"), (6, None), (7, "no scheme"), (8, "http://x.net/casino?a"),
        (9, "http://org"), (10, "http://x.net/casinos")], "page_id long, url string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judged(pages, urlrules.BASE + urlrules.OWN).collect()}
    assert rows[1] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert rows[2][2:] == ("org/", "allow") and rows[3][2:] == ("org/", "allow")
    assert rows[4][2:] == ("com/de/", "block") and rows[5][2:] == (None, "allow")
    assert rows[6] == ("", "", None, "allow") == rows[7] and rows[8][2:] == (None, "block")
    assert rows[9] == ("org", "", None, "allow") and rows[10][3] == "allow"


@pytest.mark.parametrize("limits", [{}, {"CELLS": 3, "BLOCK_ROWS": 30, "QUERY_ROWS": 4, "RECORD_COMPONENTS": 64, "READ": 1}])
def test_top_k(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(vafile, name, value)
    if "CELLS" in limits:
        monkeypatch.setattr(vafile.approximation_file, "__defaults__", (limits["CELLS"],))
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(400, [1.0] * 8), (401, [1.0] * 8), (401, [1.0] * 8)]
    rows += [(500, None), (520, [float("nan")] * 8), (540, [1.0]), (541, [2.0]), (560, [None] * 8), (580, []), (581, []), (None, [1.0] * 8)]
    rows += [(600 + i, [0.5, -0.25] * 4) for i in range(60)] + [(700, [300.0] * 8), (701, [-1e6] * 8)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, row int").repartition(3)
    got = collections.defaultdict(list)
    for r in sorted(vafile.top_k(frame, k=5).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, own in ((i, v) for i, v in whole if i % 20 == 0):
        scores = [(i, sum(a * b for a, b in zip(own, v))) for i, v in whole if i != q and len(v) == len(own)]
        assert got[q] == sorted(scores, key=lambda s: (-s[1], s[0]))[:5], q
    assert vafile.top_k(frame.filter("vec_id < 0")).count() == 0


def test_cells_bound_every_score():
    rng = np.random.default_rng(6)
    for most in (5, 3000, 10**9):
        v, queries = rng.integers(-most, most + 1, (50, 6)), rng.integers(-most, most + 1, (9, 6))
        for cells in (2, 16, 256):
            batch = vafile._record(0, 6, np.arange(50), np.arange(50), v, cells)
            record = vafile.Record(*[batch.column(c)[0].as_py() for c in ("ids", "rows", "low", "width", "cells")])
            at_low, less, more = record.bounds(queries)
            scores = queries @ v.T
            assert (at_low + less[:, None] <= scores).all() and (scores <= at_low + more[:, None]).all()
            assert len(batch.column("cells")[0].as_py()) == v.size


def test_trimmed_work_yields_all_batches(docs, none):
    @shared.trimmed
    def same(batches):
        yield from batches

    for rows in (docs, none):
        assert sorted(map(str, rows.mapInArrow(same, rows.schema).collect())) == sorted(map(str, rows.collect()))


def test_only_words_with_the_space_mark_are_spelt_in_bytes():
    plain = pieces.DropoutEncoder(pieces.PIECE_BPE, 1, 0.0)
    for text in ["some common words  and a▁b here ", "▁", " ▁x▁  y", "word ▁▁"]:
        assert plain.decode(plain.ids(1, text)) == text
    assert len(plain.ids(1, "some common words and a▁b here")) // 4 < 16


@pytest.mark.parametrize("sent", [jaccard.SENT_ROWS, -1])
def test_no_unique_text_goes_with_its_id(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT_ROWS", sent)
    u, v = " ".join(f"u{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, u), (9, u), (9, v), (9, v), (10, u), (10, None), (11, ""), (None, u), (12, v + " x")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, row string, ROW2 int")
    kept = jaccard.one_of_each(docs, jaccard.Join(n=5, percent=80))
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(5, u), (9, v), (10, None), (11, ""), (None, u)])
