import random
from collections import Counter
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfcast.operators import cleaning, facts
from shelfcast.schemas import RAW_FIELDS

FIELDS = ["invoice", "quantity", "customer"]
REPLICAS = [(2, 1, 5, None, "a"), (3, 1, 5, None, "a"), (4, 1, 5, None, "b"), (5, 1, 5, None, "b"),
            (6, 1, 5, None, "b"), (7, 1, 6, None, "b"), (8, 1, 5, None, "a")]


def replica_frame(spark, data=REPLICAS):
    return spark.createDataFrame(
        data, "row long, invoice int, quantity int, customer double, source string")


def brute_replicas(data):
    """Occurrence numbers and matches, one line after the other."""
    seen, listed, out = Counter(), set(), {}
    for row, *line, source in sorted(data):
        k = tuple(line)
        n = seen[(k, source)]
        seen[(k, source)] += 1
        out[row] = (n, (k, n) in listed)
        listed.add((k, n))
    return out


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_replicas_follow_input_order(spark, span):
    chunk = F.floor(F.col("row") / span)
    found = cleaning.flag_replicas(replica_frame(spark), FIELDS, "source", ["row"], chunk)
    assert {r["row"]: r["is_replica"] for r in found.collect()} == {
        2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: True}


def test_one_line_that_fills_a_third_of_the_table(spark):
    rng = random.Random(5)
    data = [(i, 1, 1 if rng.random() < 0.34 else rng.randrange(40), None, rng.choice("abc"))
            for i in range(900)]
    chunk = F.floor(F.col("row") / 50)
    found = cleaning.flag_replicas(replica_frame(spark, data), FIELDS, "source", ["row"], chunk)
    got = {r["row"]: (r["occurrence"], r["is_replica"]) for r in found.collect()}
    want = brute_replicas(data)
    assert got == want
    lines = cleaning.distinct_lines(
        replica_frame(spark, data), FIELDS, "source", ["a", "b", "c"], "row").collect()
    kept = [d for d in data if not want[d[0]][1]]
    for line in lines:
        same = [d for d in kept if tuple(d[1:4]) == (line.invoice, line.quantity, line.customer)]
        assert line.copies == len(same) and line.last_position == max(d[0] for d in same)
    assert sum(x.raw_rows for x in lines) == len(data)


RAW = "source string, row long, " + ", ".join(f"{c} string" for c in RAW_FIELDS)


def line(row, source="a", **change):
    base = dict(invoice="500", stock_code="85123A", description="x", quantity="2",
                invoice_date="2020-01-01 10:00:00", price="1.5", customer_id="7", country="UK")
    return (source, row, *[(base | change)[c] for c in RAW_FIELDS])


CASES = [
    (line(1, invoice_date="soon"), "invalid_date"),
    (line(2, stock_code=" \t"), "missing_product_or_invoice"),
    (line(3, invoice=None), "missing_product_or_invoice"),
    (line(4, invoice=" c77"), "cancellation_invoice"),
    (line(5, quantity="-1"), "negative_quantity"),
    (line(6, quantity="0"), "zero_or_invalid_quantity"),
    (line(7, quantity="many"), "zero_or_invalid_quantity"),
    (line(8, quantity="NaN"), "zero_or_invalid_quantity"),
    (line(9, stock_code="POST"), "non_product_code"),
    (line(10, stock_code="gift_0001_20"), "non_product_code"),
    (line(11, stock_code="851234A"), "non_product_code"),
    (line(12, price="0"), "nonpositive_or_invalid_price"),
    (line(13, price=None), "nonpositive_or_invalid_price"),
    (line(14, invoice_date="2020-01-09 00:00:00"), "final_incomplete_day"),
    (line(15, stock_code="\t85123a ", description="padded"), "retained"),
    (line(16, description="kept"), "retained"),
    (line(17, source="b", description="kept"), "cross_sheet_replica"),
    # Several flags at once: the first in priority order wins.
    (line(18, invoice="C9", quantity="-4", price="0"), "cancellation_invoice"),
    (line(19, invoice_date="x", invoice=""), "invalid_date"),
    (line(20, quantity="-4", stock_code="M"), "negative_quantity"),
    # A replica that is also invalid counts under the higher-ranked reason.
    (line(21, source="b", invoice_date="soon"), "invalid_date"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([c[0] for c in CASES], RAW)


def flagged(raw, position="row"):
    last = cleaning.coverage_bounds(cleaning.coerce_types(raw)).select("final_day").scalar()
    lines = cleaning.distinct_lines(raw, RAW_FIELDS, "source", ["a", "b"], position)
    return cleaning.flag_distinct(cleaning.typed_lines(lines), last)


def test_line_reasons(raw):
    typed = cleaning.typed_lines(raw)
    marked = cleaning.flag_replicas(typed, RAW_FIELDS, "source", ["row"], F.lit(0))
    found = cleaning.flag_lines(marked, F.lit(date(2020, 1, 9)))
    assert {r["row"]: r["reason"] for r in found.collect()} == {c[0][1]: c[1] for c in CASES}
    counts = {n: found.filter(n).count() for n in cleaning.REASONS}
    overlap = {r["flag"]: r["rows"] for r in cleaning.overlapping_flag_counts(flagged(raw)).collect()}
    assert counts == overlap and counts["negative_quantity"] == 3


def test_exclusive_counts_cover_every_line(raw):
    counts = {r["reason"]: r["rows"] for r in cleaning.exclusive_reason_counts(flagged(raw)).collect()}
    want = Counter(c[1] for c in CASES)
    assert counts == {name: want.get(name, 0) for name in [*cleaning.REASONS, "retained"]}
    assert sum(counts.values()) == len(CASES)


def test_duplicates_missing_and_excluded_codes(raw):
    found = flagged(raw)
    assert tuple(cleaning.duplicate_accounting(found).first()) == (2, 2, 0)
    assert tuple(cleaning.missing_value_counts(found).first()) == (0, 0, 0)
    codes = cleaning.non_product_code_counts(cleaning.typed_lines(raw)).collect()
    assert {(r["stock_code"], r["rows"]) for r in codes} == {
        ("POST", 1), ("gift_0001_20", 1), ("851234A", 1), ("M", 1), (" \t", 1)}


def test_fact_agrees_with_audit_totals_and_keeps_no_customer(raw):
    lines = cleaning.merchandise(flagged(raw))
    fact = facts.product_day_sales(lines)
    total = cleaning.audit_totals(lines).first()
    sums = fact.agg(F.sum("transaction_lines"), F.sum("units"), F.sum("positive_sales_gbp")).first()
    assert (total.retained_rows, total.positive_units, total.positive_sales_gbp) == tuple(sums)
    assert total.retained_rows == 2 and total.product_count == 1
    assert not {"customer_id", "invoice", "country"} & set(fact.columns)


def spread(lines, fields):
    """Copies and last positions, with lines that were left apart put together."""
    out = {}
    for r in lines.collect():
        key = tuple(r[c] for c in fields)
        copies, last = out.get(key, (0, -1))
        out[key] = (copies + r.copies, max(last, r.last_position))
    return out


@pytest.mark.parametrize("hashes", [1 << 62, 3, 1])
@pytest.mark.parametrize("sent", [1_000_000, -1])
def test_hash_first_matching_gives_the_same_lines(spark, monkeypatch, hashes, sent):
    """However many lines share a hash, and whether hashes are sent or joined."""
    rng = random.Random(9)
    days = ["2020-01-01 10:00:00", "2020-01-01 11:00:00", "2020-01-02 10:00:00", None, "soon"]
    data = [(rng.choice("ab"), k, rng.choice([None, "1", "2"]), rng.choice(["x", None]), "d", rng.choice("12"),
             rng.choice(days), "1.5", rng.choice([None, "7"]), "UK") for k in range(400)]
    data += [("a", 400 + k, "9", "x", "d", "1", "2020-02-01 10:00:00", "1.5", "7", "UK") for k in range(5)]
    raw = spark.createDataFrame(data, RAW).repartition(3)
    want = {}
    for key in {tuple(d[2:]) for d in data}:
        at = {s: [d[1] for d in data if tuple(d[2:]) == key and d[0] == s] for s in "ab"}
        copies = max(map(len, at.values()))
        want[key] = (copies, min(max(v) for v in at.values() if len(v) == copies))
    whole = cleaning.line_hash(RAW_FIELDS)
    monkeypatch.setattr(cleaning, "line_hash", lambda fields: F.pmod(whole, F.lit(hashes)))
    monkeypatch.setattr(cleaning, "HASHES_SENT", sent)
    args = (raw, RAW_FIELDS, "source", ["a", "b"], "row")
    lines = cleaning.distinct_lines(*args)
    assert spread(lines, RAW_FIELDS) == want and lines.count() == len(want)
    assert lines.agg(F.sum("raw_rows")).first()[0] == len(data)
    for day in (None, F.left(F.col("invoice_date"), F.lit(10))):
        apart = cleaning.distinct_lines(*args, apart=True, day=day)
        assert spread(apart, RAW_FIELDS) == want
        assert apart.agg(F.sum("raw_rows")).first()[0] == len(data)


def test_a_line_of_an_unnamed_source_stops_the_run(spark):
    raw = spark.createDataFrame([line(1), line(2, source="c")], RAW)
    with pytest.raises(PySparkException, match="not named"):
        cleaning.distinct_lines(raw, RAW_FIELDS, "source", ["a", "b"]).collect()


def test_lines_that_stand_alone_are_not_shuffled(raw):
    lines = cleaning.distinct_lines(raw, RAW_FIELDS, "source", ["a", "b"], apart=True)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_profile_and_bounds(raw):
    typed = cleaning.typed_lines(raw)
    assert {(r.source, r.raw_rows) for r in cleaning.source_profile(typed, "source").collect()} == {
        ("a", 19), ("b", 2)}
    assert tuple(cleaning.coverage_bounds(typed).first()) == (
        date(2020, 1, 1), date(2020, 1, 8), date(2020, 1, 9))
