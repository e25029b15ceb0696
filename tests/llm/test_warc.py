"""Archives against plain Python over the given pages, look-ups by the index, and odd streams."""

import base64
import gzip
import hashlib
import os

import pytest

from shelfcast.llm import warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    """(page, bytes, digest, kind, page referred to) by the definition."""
    first, out = {}, []
    for key, html in rows:
        payload = (html or "").encode()
        if key is not None:
            first[payload] = min(first.get(payload, key), key)
    for key, html in rows:
        payload = (html or "").encode()
        again = key is not None and first[payload] != key
        out.append((key, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if again else "response", first[payload] if again else None))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_query_equals_the_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = [tuple(r) for r in warc.op2_warc_normaliser(spark, SF).collect()]
    assert sorted(got, key=repr) == expected(rows)


@pytest.mark.parametrize("sent", [warc.RANGES_SENT, -1])
def test_chosen_records_are_read_by_their_ranges(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "RANGES_SENT", sent)
    rows = [(k, f"http://h/{k}", f"text {k % 40} " * (k % 7)) for k in range(300)] + [(300, None, None), (301, "u", "é" * 5000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string").repartition(5)
    warc.write_monolithic(warc.with_revisits(pages, 0), str(tmp_path / "raw"))
    warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    whole = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in whole), key=repr) == expected(
        [(k, h) for k, _, h in rows])
    index = warc.read_index(spark, str(tmp_path / "out"))
    assert index.filter("url = 'http://h/17' AND date IS NOT NULL").count() == 1
    one = warc.read_archives(spark, str(tmp_path / "out"), index.filter("page_id IN (17, 301)")).collect()
    assert {r.page_id: bytes(r.block) for r in one} == {17: ("text 17 " * 3).encode(), 301: ("é" * 5000).encode()}
    assert warc.read_archives(spark, str(tmp_path / "out"), index.filter("page_id < 0")).count() == 0
    lied = index.filter("page_id = 17").withColumn("page_id", index.page_id + 1)
    with pytest.raises(Exception, match="not the one that the index names"):
        warc.read_archives(spark, str(tmp_path / "out"), lied).collect()


def test_streams_are_inflated_piece_by_piece(monkeypatch):
    parts = [os.urandom(3000), b"", b"a" * 200_000, b"\0" * 5000, os.urandom(70_000)]
    whole = b"".join(gzip.compress(p) + b"\0" * k for k, p in enumerate(parts))
    for fed, out in ((1, 7), (1000, 64), (1 << 18, 1 << 20)):
        monkeypatch.setattr(warc, "FED", fed)
        monkeypatch.setattr(warc, "INFLATED", out)
        if fed > 1:
            assert b"".join(warc.inflated(whole)) == b"".join(parts)
        assert b"".join(warc.inflated(gzip.compress(b"xyz" * 50))) == b"xyz" * 50
        assert b"".join(warc.inflated(b"")) == b"" == b"".join(warc.inflated(b"\0\0"))
        with pytest.raises(ValueError, match="cut short"):
            list(warc.inflated(gzip.compress(b"xyz" * 50)[:-3]))


def test_an_empty_table_gives_no_records(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_monolithic(warc.with_revisits(pages, 0), str(tmp_path / "raw"))
    warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert warc.read_archives(spark, str(tmp_path / "out")).count() == 0
