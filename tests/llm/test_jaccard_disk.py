"""What the n-gram join leaves on disk and how it takes clusters of several blocks apart."""

import collections
import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import jaccard, shared


@pytest.fixture
def tables(monkeypatch, tmp_path):
    """Names of the tables left in a working folder of the test's own."""
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"{tmp_path}/work")
    return lambda: sorted(path.split("/")[-2].rsplit("-", 1)[0] for path in glob.glob(f"{tmp_path}/work/shelfcast-llm/*/_SUCCESS"))


def tied_groups(groups):
    """Near copies in threes; passages that a few rows of several groups hold tie all groups together."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(groups):
        base = rng.integers(0, 1 << 40, 200)
        base[:20] = np.arange(20) + 100 * (g // 2)
        base[20:40] = 50 + np.arange(20) + 100 * ((g + 1) // 2)
        for _ in range(3):
            one = base.copy()
            one[rng.choice(np.arange(40, 200), 3, replace=False)] = rng.integers(0, 1 << 40, 3)
            rows.append((g, np.unique(one)))
    return rows


def test_tied_groups_do_not_ask_each_other(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NGRAMS", 700)
    groups = tied_groups(20)
    data = [(k, len(x), x.tobytes(), len(x)) for k, (_, x) in enumerate(groups)]
    rows = shared.written(spark.createDataFrame(data, "row long, size long, columns binary, common long"), "rows")
    leading = [(k, int(c)) for k, (_, x) in enumerate(groups) for c in np.sort(x)[:40]]
    monkeypatch.setattr(jaccard, "leading_columns", lambda *_: spark.createDataFrame(leading, "row long, column long"))
    placed = jaccard.placed_rows(rows, jaccard.Join()).collect()
    assert len(placed) == 60 and {r.blocks for r in placed} == {1}
    of = collections.defaultdict(set)
    for r in placed:
        of[r.cluster].add(groups[r.row][0])
    assert all(len(g) == 1 for g in of.values()) and len(of) == 20


@pytest.mark.parametrize("most", [jaccard.MARKED_ROWS, 5])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_close_pairs_lose_no_link(spark, monkeypatch, most, batch):
    """Also where a column's rows are too many to be compared and come in several batches."""
    monkeypatch.setattr(jaccard, "MARKED_ROWS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng, join = np.random.default_rng(8), jaccard.Join()
        base = [rng.integers(0, 1 << 40, 80) for _ in range(3)]
        rows = []
        for k in range(90):
            one = base[k % 3].copy()
            one[rng.choice(80, rng.integers(0, 6), replace=False)] = rng.integers(0, 1 << 40)
            rows.append((k, np.unique(np.append(one, 5))))
        data = spark.createDataFrame([(k, len(x), x.tobytes()) for k, x in rows], "row long, size long, columns binary")
        leading = spark.createDataFrame([(k, int(c)) for k, x in rows for c in x], "row long, column long")
        found = dict(jaccard.clusters(data, leading, join).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, x in rows:
        for b, y in rows:
            both = np.array([len(np.intersect1d(x, y))])
            if a < b and join.linked(both, len(x), np.array([len(y)]))[0]:
                assert found[a] == found[b]
    if most > 90:
        assert len(set(found.values())) == 3


def test_marks_bound_the_difference():
    rng = np.random.default_rng(2)
    for size in (1, 50, 400_000):
        x = np.unique(rng.integers(-(1 << 62), 1 << 62, size))
        y = np.unique(np.append(x[size // 10:], rng.integers(-(1 << 62), 1 << 62, size // 8)))
        a, b = (np.frombuffer(jaccard._marks(z), np.uint8).astype(int) for z in (x, y))
        assert len(a) == jaccard.MARKS and np.abs(a - b).sum() <= len(np.setxor1d(x, y))


def test_join_leaves_few_tables(spark, tables):
    words = [f"w{k}" for k in range(400)]
    texts = [(k, " ".join(words[k % 40 * 5: k % 40 * 5 + 60] + [f"x{k}"])) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = jaccard.similar_documents(docs)
    assert {"names", "news"} <= set(tables()) <= {"names", "news", "edges", "pairs"}
    assert found.count() == 120


def test_repeated_rows_count_once(spark, monkeypatch):
    """Rows that come several times with one id take part in the product once."""
    rng, listed = np.random.default_rng(4), []
    pairs = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 80)) for _ in range(12)]
    rows = [(2 * k + j, text + " end" * j) for k, text in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame([r for r in rows for _ in range(3)], "doc_id long, text string").repartition(5)
    placed = jaccard.links

    def links(full, join):
        listed.append([r.row for r in full.select("row").collect()])
        return placed(full, join)

    monkeypatch.setattr(jaccard, "links", links)
    found = collections.Counter((r.doc_id, r.component_id) for r in jaccard.similar_documents(docs).collect())
    assert found == {(k, k // 2 * 2): 3 for k, _ in rows}
    assert len(listed[0]) == len(set(listed[0])) == len(rows)


@pytest.mark.parametrize("before", [None, "false"])
def test_shuffles_go_with_their_query(spark, before, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if before:
        spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    jvm = spark.sparkContext._jvm

    def shuffled():
        found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    try:
        old = shuffled()
        table = jaccard._written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t")
        for _ in range(40):
            left = shuffled() - old
            if not left:
                break
            time.sleep(0.25)
        assert not left and table.count() == 7 and spark.conf.get(key, None) == before
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_pipeline_keeps_one_stage_between_stages(spark, tables, tmp_path, monkeypatch):
    import corpus_pipeline

    def plain(spark, docs, sf_dir):
        return docs.withColumn("n", F.col("n") + 1)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), plain) for k in range(4)])
    spark.range(5).withColumn("n", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert tables() == ["stage-2"]
    assert {r.n for r in out.collect()} == {4} and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 5
