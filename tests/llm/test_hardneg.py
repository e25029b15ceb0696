"""Hard negatives against Python integers, and the residue products at their limits."""

import os
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from shelfcast.llm import hardneg

SF = "/root/testdata/sf0.01"


def expected(rows, mining=hardneg.Mining()):
    """By the definition, one row at a time; rows are (vec_id, label, vector)."""
    live = []
    for k, label, v in rows:
        if k is None or label is None or v is None or any(x is None or not isfinite(x) for x in v):
            continue
        if k % mining.noise_step == 0:
            label = (label + 1) % mining.labels
        live.append((k, label, [floor(Fraction(x) * mining.scale) for x in v]))
    out = []
    for i, (k, label, v) in enumerate(live):
        if k % mining.anchor_step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), n, j, own) for j, (n, own, w) in enumerate(live) if j != i and len(w) == len(v)]
        scored.sort()
        for top, p, _, _ in [s for s in scored if s[3] == label][: mining.positives]:
            hard = [s for s in scored if s[3] != label and mining.low * -top <= 100 * -s[0] <= mining.high * -top]
            out += [(k, p, r + 1, s[1], -top, -s[0]) for r, s in enumerate(hard[: mining.negatives])]
    return sorted(out)


def read(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_products_are_exact_at_any_width_and_size():
    rng = np.random.default_rng(3)
    for width, most in [(1, 10**6), (64, 300), (64, 1 << 24), (5000, 4000), (0, 1), (10_000, 127)]:
        a, b = rng.integers(-most, most + 1, (7, width)), rng.integers(-most, most + 1, (9, width))
        if width:
            a[0], b[0], b[1] = most, most, -most
        want = a.astype(object) @ b.astype(object).T if width else np.zeros((7, 9), int)
        system = hardneg.Residues(width, most * most * max(width, 1))
        assert (system.product(system.split(a), system.split(b)) == want).all()
        assert all(system.part * (p // 2) ** 2 < 1 << 24 for p in system.primes)
    with pytest.raises(OverflowError):
        hardneg.Residues(64, 1 << 62)


def odd_rows():
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-3, 6, 6).astype(float).tolist()) for i in range(160)]
    rows += [(50, 1, [2.0] * 6), (50, 1, [2.0] * 6), (51, 1, [2.0] * 6), (51, 1, [2.0] * 6)]
    rows += [(200, 2, None), (250, None, [1.0] * 6), (300, 1, [None] + [1.0] * 5), (350, 1, [float("nan")] * 6), (400, 1, [float("inf")] * 6)]
    rows += [(None, 1, [1.0] * 6), (450, 3, []), (451, 3, []), (452, 2, []), (500, 9, [1.0, -0.5]), (501, 9, [0.7, 0.1]), (502, 3, [0.6, 0.1])]
    return rows + [(550 + i, i % 2, [1.5, 0.25, -1.0, 2.0, 0.0, 1.0]) for i in range(60)]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 16, "ANCHOR_ROWS": 2}])
def test_odd_rows_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(hardneg, name, value)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, v string, row int").repartition(4)
    want = expected(rows)
    assert len(want) > 50
    assert read(hardneg.hard_negatives(frame)) == want
    assert hardneg.hard_negatives(frame.filter("vec_id < 0")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(db.execute(hardneg.SQL).fetchall())
    assert want and read(hardneg.op13_rns_hard_negatives(spark, SF)) == want
