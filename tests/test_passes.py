"""How often lines are read, shuffled and written; results are compared elsewhere."""

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import cleaning, facts
from shelfcast.plans import audit
from shelfcast.sources import files, store, tables
from test_cleaning import FIELDS, brute_replicas, replica_frame

SF = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def refuse(*args, **options):
    raise AssertionError("another pass over the lines")


@with_tables
def test_raw_lines_are_made_as_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(store, "stored_by", refuse)
    assert tables.messy_lines(spark, SF).count() == tables.table(spark, SF, "lineitem").count()


@with_tables
def test_the_days_that_the_lines_cover_are_looked_for_once(spark, monkeypatch, capsys):
    tables.audited_lines(spark, SF, "position", last=F.lit(date(2001, 11, 4))).explain()
    assert "min(" not in capsys.readouterr().out


def test_lines_are_shuffled_once_for_the_fact(spark, capsys):
    lines = spark.createDataFrame(
        [("a", date(2020, 1, 1), 2.0, 10.0, "old", 1, 1)],
        "product_id string, date date, units double, unit_price double, description string, last_position long, copies long")
    facts.product_day_sales(lines).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


@pytest.mark.parametrize("sent", [cleaning.HASHES_SENT, 0])
def test_only_lines_of_several_sources_are_numbered(spark, monkeypatch, sent):
    monkeypatch.setattr(cleaning, "HASHES_SENT", sent)
    rng, numbered = random.Random(8), []
    data = [(i, 1, rng.randrange(60), rng.choice([None, 1.0]), rng.choice("aab")) for i in range(200)]
    data += [(i, 2, i, None, rng.choice("ab")) for i in range(200, 500)]

    def numbering(lines, *rest, whole=cleaning.flag_replicas):
        numbered.append(lines.count())
        return whole(lines, *rest)

    monkeypatch.setattr(cleaning, "flag_replicas", numbering)
    found = cleaning.flag_shared_replicas(
        replica_frame(spark, data), FIELDS, "source", ["a", "b"], ["row"], F.floor(F.col("row") / 50))
    want = brute_replicas(data)
    assert {r["row"]: r["is_replica"] for r in found.collect()} == {row: w[1] for row, w in want.items()}
    assert any(w[1] for w in want.values()) and 0 < numbered[0] <= 200


def test_source_files_are_counted_in_one_pass(spark, monkeypatch, tmp_path, capsys):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(",".join(files.SOURCE_COLUMNS) + "\n" + "1,2,3,4,5,6,7,8\n" * 3)

    def listing(frame, name, write=files.written):
        frame.explain()
        return write(frame, name)

    monkeypatch.setattr(files, "written", listing)
    found = files.read_source_folders(spark, str(tmp_path))
    assert capsys.readouterr().out.count("FileScan csv") == 1
    assert sorted((r.source, r.source_order, r.source_rows, r.position) for r in found.collect()) == [
        (s, i, 3, n) for i, s in enumerate("ab") for n in range(3)]


@with_tables
def test_the_copy_of_the_fact_uses_the_key_that_the_run_has(spark, monkeypatch):
    monkeypatch.setattr(files, "content_key", refuse)
    assert audit.a3(spark, SF).count() > 0
