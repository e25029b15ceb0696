import hashlib

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfcast.operators import checks, cleaning, hygiene
from shelfcast.schemas import RAW_FIELDS, SALES_SCHEMA, SOURCE_COLUMNS
from shelfcast.sources import files

HEADER = list(SOURCE_COLUMNS)


def write_source(path, data, header=HEADER):
    path.mkdir()
    text = "\n".join(",".join(r) for r in [header, *data]) + "\n"
    (path / "part.csv").write_text(text)


LINE = ["500", "85123a", "LAMP", "2", "2020-01-01 10:00:00", "1.50", "7", "UK"]


def test_sources_keep_names_and_input_order(spark, tmp_path):
    write_source(tmp_path / "one", [LINE, LINE, [*LINE[:3], "9", *LINE[4:]]])
    write_source(tmp_path / "two", [LINE, [*LINE[:3], "5", *LINE[4:]]])
    raw = files.read_sources(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")})
    ordered = raw.orderBy(*files.INPUT_ORDER).collect()
    assert [(r.source, r.quantity) for r in ordered] == [
        ("one", "2"), ("one", "2"), ("one", "9"), ("two", "2"), ("two", "5")]
    marked = cleaning.flag_replicas(raw, RAW_FIELDS, "source", files.INPUT_ORDER, F.col("source_order"))
    assert marked.filter("is_replica").count() == 1
    raw.select(*[F.col(n).alias(c) for c, n in SOURCE_COLUMNS.items()]).write.parquet(str(tmp_path / "pq"))
    again = files.read_sources(spark, {"pq": str(tmp_path / "pq")}, "parquet")
    assert again.count() == 5 and again.filter("source_row is null").isEmpty()


def test_column_differences_stop_ingestion(spark, tmp_path):
    write_source(tmp_path / "bad", [LINE[:-1]], HEADER[:-1])
    with pytest.raises(ValueError, match="bad lacks the declared columns"):
        files.read_sources(spark, {"bad": str(tmp_path / "bad")})
    with pytest.raises(ValueError, match="lacks the declared columns"):
        files.union_sources({"a": spark.range(1), "b": spark.range(1).withColumnRenamed("id", "x")})


def folders(tmp_path, spark, fmt, sources):
    """Sources as folders of several files; each file is a list of lines, or has a header of its own."""
    for source, parts in sources.items():
        (tmp_path / source).mkdir(parents=True)
        for k, part in enumerate(parts):
            header, data = part if isinstance(part, tuple) else (HEADER, part)
            if fmt == "csv":
                text = "\n".join(",".join(r) for r in [header, *data]) + "\n"
                (tmp_path / source / f"part-{k}.csv").write_text(text)
            else:
                frame = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in header))
                frame.coalesce(1).write.parquet(str(tmp_path / source / f"part-{k}.parquet"))
    return str(tmp_path)


def line(k):
    return [*LINE[:3], str(k), *LINE[4:]]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_folders_are_sources_with_places_through_all_files(spark, tmp_path, rows, fmt):
    root = folders(tmp_path, spark, fmt, {
        "source=b": [[line(k) for k in range(5)], [line(k) for k in range(5, 7)]],
        "source=a": [[line(k) for k in range(10, 13)]], "source=c": [[line(k) for k in (30,)], [line(k) for k in (31, 32)]]})
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # several blocks in each text file
        found = files.read_source_folders(spark, root, fmt).filter("quantity <> '11'")
        got = rows(found, "source", "position", "quantity")
        totals = rows(found.select("source", "source_order", "source_rows").distinct())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("b", k, str(k)) for k in range(7)] + [("a", 0, "10"), ("a", 2, "12")]
                         + [("c", k, str(30 + k)) for k in range(3)])
    assert totals == [("a", 0, 3), ("b", 1, 7), ("c", 2, 3)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
@pytest.mark.parametrize("header", [HEADER[:-1], [*HEADER, "Extra"], [*HEADER[:-1], "Land"]])
def test_a_later_file_with_other_columns_is_refused(spark, tmp_path, fmt, header):
    root = folders(tmp_path, spark, fmt, {"a": [[LINE]], "b": [[LINE], (header, [[*LINE, "x"][: len(header)]])]})
    with pytest.raises((ValueError, PySparkException, Py4JJavaError)):
        files.read_source_folders(spark, root, fmt).collect()


def test_checksums_and_manifest(spark, tmp_path, rows):
    folder = tmp_path / "files"
    folder.mkdir()
    for name, content in (("a.bin", b"x" * 100_000), ("b.bin", b""), ("c.bin", b"new")):
        (folder / name).write_bytes(content)
    found = files.file_checksums(spark, str(folder)).select(
        F.element_at(F.split("path", "/"), -1).alias("key"), "sha256")
    assert dict(rows(found)) == {
        p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir() if p.read_bytes()}
    manifest = spark.createDataFrame(
        [("a.bin", hashlib.sha256(b"x" * 100_000).hexdigest()), ("c.bin", "0"), ("sub\\d.bin", "1")],
        "key string, sha256 string")
    status = files.verify_manifest(manifest, found)
    assert rows(status, "key", "status") == [
        ("a.bin", "ok"), ("c.bin", "changed"), ("sub/d.bin", "missing")]
    for key in ("/etc/x", "..\\x", "C:\\x", "a/../b"):
        bad = spark.createDataFrame([(key, "0")], "key string, sha256 string")
        with pytest.raises(PySparkException, match="not a relative key"):
            files.verify_manifest(bad, found).collect()


@pytest.mark.parametrize("split", [100, 10_000])
def test_checksums_of_files_read_in_steps(spark, tmp_path, rows, monkeypatch, split):
    mark, mixed = b"\xef\xbb\xbf", bytes(range(256)) * 3
    contents = {
        "mixed": mixed, "feed at the end": mixed + b"\n", "feeds": b"\n" * 600, "returns": b"ab\r\n\r" * 90, "zeros": bytes(777),
        "mark": mark + mixed, "mark and feed": mark + b"\n" + mixed + b"\n", "two marks": mark + mark + mixed,
        "one line": b"x" * 700, "a long line": b"a\n" * 50 + b"y" * 600 + b"\nb\n", "many lines": b"0123456\n" * 320,
        "one byte too long": b"a\n" * 50 + b"y" * 501 + b"\nb", "whole [blocks] {a,b}*%20": b"0123456\n" * 64 * 3, "named.gz": mixed, "named.txt.bz2": mixed,
        "as much as a step": mixed[:200], "one more": mixed[:201], "empty": b"", "short": b"\n"}
    for k, (name, content) in enumerate(contents.items()):
        folder = tmp_path / f"k={k % 2}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(content)
    for name, most in (("FILE_STEP", 200), ("LINE_MOST", 500)):
        monkeypatch.setattr(files, name, most, raising=False)
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.sources.binaryFile.maxLength": 800}  # 2 GB in small
    try:
        for name, value in settings.items():
            spark.conf.set(name, str(value))
        got = rows(files.file_checksums(spark, str(tmp_path)).withColumn(
            "name", F.element_at(F.split("path", "/"), -1)), "name", "length", "sha256")
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == sorted(((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c), key=repr)


def test_a_digest_goes_on_from_what_was_stored():
    content = bytes(range(256)) * 5
    for cut in (0, 1, 63, 64, 65, 1000):
        digest = files.digests.Digest()
        digest.update(content[:cut])
        assert digest.hexdigest() == hashlib.sha256(content[:cut]).hexdigest()
        again = files.digests.Digest(digest.stored())
        again.update(content[cut:])
        assert again.hexdigest() == hashlib.sha256(content).hexdigest()


def test_content_cache_is_reused_until_the_input_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    label = f"doubled-{tmp_path.name}-{hashlib.sha256(str(tmp_path).encode()).hexdigest()[:8]}"

    def build():
        return spark.read.parquet(source).selectExpr("id * 2 AS v")

    def made():
        return files.materialize_by_content(spark.read.parquet(source), label, build)

    assert made()[1] is False
    cached, reused = made()
    assert reused and cached.count() == 5
    spark.range(7).write.mode("append").parquet(source)
    changed, reused = made()
    assert not reused and changed.count() == 12


def test_content_keys_ignore_order_and_see_every_value(spark):
    data = [("a", None, 1.0), (None, "a", 1.0), ("ab", "c", 2.0), ("a", "bc", 2.0), ("a", "bc", 2.0)]
    schema = "x string, y string, z double"
    key = files.content_key(spark.createDataFrame(data, schema).coalesce(1))
    assert files.content_key(spark.createDataFrame(data[::-1], schema).repartition(7)) == key
    others = [data[:-1], [*data, data[-1]], [("a", None, 1.0)] * 2 + data[2:], [*data[:2], ("a", "bc", 2.0), *data[3:]],
              [*data[:-1], ("a", "bc", 2.5)]]
    keys = {files.content_key(spark.createDataFrame(o, schema)) for o in others}
    assert key not in keys and len(keys) == len(others)
    assert files.content_key(spark.createDataFrame(data, "x string, y string, w double")) != key
    assert files.content_key(spark.createDataFrame([], schema)) not in {key, *keys}


def test_csv_keeps_ids_as_text_and_floats_exact(spark, tmp_path, rows):
    data = [("00123", "2020-01-01", 0.1 + 0.2, None, 1, "a, \"quoted\" name")]
    frame = spark.createDataFrame(
        data, "product_id string, d string, units double, v string, transaction_lines long, description string"
    ).select("product_id", F.to_date("d").alias("date"), "units",
             F.col("v").cast("decimal(38,4)").alias("positive_sales_gbp"), "transaction_lines", "description")
    files.write_csv(frame, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), SALES_SCHEMA)) == rows(frame)


def test_json_refuses_nonfinite_numbers_at_any_depth(spark, tmp_path, rows):
    nested = "id string, s struct<x: double, a: array<double>>"
    good = spark.createDataFrame([("a", (1.5, [1.0, None])), ("b", None)], nested)
    files.write_json(good, str(tmp_path / "good"))
    assert rows(spark.read.schema(good.schema).json(str(tmp_path / "good"))) == rows(good)
    for i, bad in enumerate([(float("nan"), [1.0]), (1.0, [float("inf")])]):
        with pytest.raises(PySparkException, match="Out of range"):
            files.write_json(spark.createDataFrame([("a", bad)], nested), str(tmp_path / f"bad{i}"))


def test_reconciliation(spark, rows):
    schema = "model string, product_id string, wape double, sales_value double, wins long, note string"
    left = spark.createDataFrame([("m", "a", 1.0, 5.0, 1, "x"), ("m", "b", None, 1.0, 2, "y")], schema)
    near = spark.createDataFrame(
        [("m", "b", None, 1.0 + 5e-7, 2, "y"), ("m", "a", 1.0 + 5e-9, 5.0, 1, "x")], schema)
    assert checks.unique_key(left, near) == ["product_id"]
    assert checks.table_reconcile(left, near).filter("differences > 0").isEmpty()
    far = spark.createDataFrame(
        [("m", "a", 1.0 + 1e-7, 5.0, 2, "x"), ("m", "c", 0.0, 0.0, 0, "z")], schema)
    found = {r.item: r.differences for r in checks.table_reconcile(left, far).collect()}
    assert found == {"only_left": 1, "only_right": 1, "model": 0, "wape": 1, "sales_value": 0, "wins": 1, "note": 0}
    renamed = left.withColumn("model", F.lit("new"))
    assert checks.metric_reconcile(renamed, left, {"new": "m"}).filter("differences > 0").isEmpty()
    with pytest.raises(ValueError, match="Schema differs"):
        checks.table_reconcile(left, left.drop("note"))
    with pytest.raises(ValueError, match="tells the rows"):
        checks.unique_key(left.unionByName(left), near)


def test_the_smallest_key_of_both_sides_is_found_in_one_pass(spark):
    data = [("m", "a", "x", 1), ("m", "b", "x", 1), ("n", "a", "x", 2), ("n", "b", None, 2), (None, "b", "y", 3)]
    left = spark.createDataFrame(data, "model string, product_id string, note string, wins long")
    assert checks.unique_key(left, left.limit(0)) == ["model", "product_id"]
    assert checks.unique_key(left, left, ["wins", "product_id"]) == ["wins", "product_id"]
    more = spark.createDataFrame([("m", "a", "x", 1), ("m", "a", "z", 1)], left.schema)
    assert checks.unique_key(left, more) == ["model", "product_id", "note"]
    assert checks.unique_key(left.filter("model = 'm'"), left.limit(1)) == ["product_id"]
    with pytest.raises(ValueError, match="columns can be tried"):
        checks.unique_key(left, left, list("abcdefg"))


def test_credentials_are_found_and_withheld(spark, rows):
    texts = ["plain words", "key " + "gh" + "p_" + "a" * 36, "AK" + "IA" + "B" * 16 + " and more",
             "-----BEGIN RSA " + "PRIVATE KEY-----", "s" + "k-" + "x" * 32, "s" + "k-short"]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = hygiene.credential_findings(items, "id", "text")
    assert [r[0] for r in rows(found)] == [1, 2, 3, 4] and "text" not in found.columns
