import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.operators import joins, quality, shift_test
from quarrymill.operators.rejects import load_records, rejected_rows, split_record, valid_rows

RAW = "row_no bigint, file_name string, delim string, line string"


def reasons(spark, lines, delim=","):
    df = spark.createDataFrame([(i, f"f{i % 3}", delim, x) for i, x in enumerate(lines)], RAW)
    found = rejected_rows(load_records(df)).collect()
    return {i: sorted(r.reason for r in found if r.row_no == i) for i in range(len(lines))}


def test_reasons(spark):
    good = "1,a@x.example,EU,1.50,2026-01-05,true"
    cases = {
        good: [],
        '"1","a ""q""",EU,"1.50",2026-01-05,true': [],
        '1,a"b,E"U,1.50,2026-01-05,x': [],
        " +1 ,,,-0.00, 2026-01-05 ,": [],
        '1,"line\nend",EU,1.50,2026-01-05,true': [],
        good + ",": ["column_count"],
        "": ["column_count"],
        None: ["column_count"],
        "1,a": ["column_count"],
        '1,"a,EU,1.50,2026-01-05,true': ["quoting"],
        '1,"a"x,EU,1.50,2026-01-05,true': ["quoting"],
        '1,"EU" ,EU,1.50,2026-01-05,true': ["quoting"],
        '1,"a,b': ["quoting"],
        "007,a,EU,01.5,2026-02-30,true": ["amount", "order_date", "order_id"],
        "0,a,EU,1.005,2026-1-5,true": ["amount", "order_date", "order_id"],
        "9223372036854775808,a,EU,1.5000,2026-01-05,true": ["order_id"],
        ",,,,,": ["amount", "order_date", "order_id"],
        "1,a,EU,-1,0000-01-01,true": ["amount", "order_date"],
        "1,a,EU," + "9" * 37 + ",2026-01-05,t": ["amount"],
        "1,a,EU," + "9" * 36 + ".99,2026-01-05,t": [],
        " 1 ,a,EU,1,2026-01-05,t": [],
        "1," + "x" * 300_000 + ",EU,1,2026-01-05,t": [],
    }
    assert reasons(spark, list(cases)) == dict(enumerate(cases.values()))


def test_delimiters_and_typed_rows(spark):
    for d in (";", "\t"):
        df = spark.createDataFrame([(1, None, d, d.join(["+5", "a,b", "EU", "2.50", "2026-01-05", "Yes"])), (1, "f", d, "x")], RAW)
        row = valid_rows(load_records(df)).first()
        assert (row.order_id, row.customer_email, str(row.amount), str(row.order_date), row.paid) == (5, "a,b", "2.50", "2026-01-05", True)
    empty = spark.createDataFrame([], RAW)
    assert load_records(empty).count() == 0
    clash = spark.createDataFrame([(1, "f", ",", "1,2", "x", 3)], RAW + ", reasons string, order_id int")
    assert rejected_rows(load_records(clash)).first().reason == "column_count"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from('a,"\n ;é'), max_size=6), min_size=1, max_size=7), st.booleans())
def test_split_is_the_inverse_of_writing(cells, always):
    line = ",".join('"' + c.replace('"', '""') + '"' if always or c[:1] == '"' or "," in c else c for c in cells)
    assert split_record(line, ",") == cells


def test_random_records_against_the_plain_grammar(spark):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice('12",,,"x EU') for _ in range(rnd.randrange(0, 14))) for _ in range(800)]
    got = reasons(spark, lines)
    for i, x in enumerate(lines):
        cells = split_record(x, ",")
        want = ["quoting"] if cells is None else ["column_count"] if len(cells) != 6 else None
        assert want is None or got[i] == want, x


SALES = "sale_row bigint, load_id bigint, amount decimal(38,2), region string, paid boolean"
LOADS = "load_id bigint, source string"


def sales(spark, loads):
    rows, n = [], 0
    for load, make in loads.items():
        for k in range(make[0]):
            n += 1
            rows.append((n, load, *make[1](k)))
    return spark.createDataFrame(rows, SALES)


def test_findings(spark):
    from decimal import Decimal as D

    base = lambda k: (D(k) + D("0.25"), ("EU", "US", "APAC")[k % 3], k % 2 == 0)
    loads = {
        1: (600, base),
        2: (600, lambda k: (base(k)[0] + (200 if k % 10 < 7 else 0), "EU" if k % 4 else base(k)[1], base(k)[2])),
        3: (600, lambda k: (None if k % 5 == 0 else base(k)[0], base(k)[1], None if k % 7 == 0 else True)),
        4: (600, lambda k: (D(k // 4 * 4), "eu" if k % 25 == 0 else base(k)[1], base(k)[2])),
        5: (400, lambda k: (-base(k)[0] if k % 20 == 0 else base(k)[0], base(k)[1], base(k)[2])),
        7: (3, base),
    }
    table = spark.createDataFrame([(i, "a") for i in (1, 2, 3, 4)] + [(5, "b"), (6, None), (7, "c"), (8, "c")], LOADS)
    got = {tuple(r) for r in quality.LoadQuality(sales(spark, loads), table).findings().collect()}
    assert got == {
        (2, "amount", "distribution"), (2, "region", "distribution"), (3, "amount", "null_rate"), (3, "paid", "null_rate"), (3, "paid", "distribution"),
        (4, "amount", "distinct"), (4, "region", "out_of_limits"), (5, "amount", "out_of_limits"),
    }
    none = sales(spark, {1: (1, base)}).where("false")
    assert quality.LoadQuality(none, table).findings().count() == 0
    assert quality.LoadQuality(sales(spark, {1: (2, lambda k: (None, None, None)), 2: (2, base)}), table).findings().count() >= 1


def test_changes_within_a_cell_of_the_classifier(spark):
    """Loads so large that the classifier's error is small: changes that its cells hide are found all the same."""
    from pyspark.sql import functions as F

    classes = {}
    for r in spark.range(60).select(F.concat(F.lit("R"), "id").alias("region")).select("region", quality._region_class(F.col("region")).alias("k")).collect():
        classes.setdefault(r.k, []).append(r.region)
    one, other = next(v for v in classes.values() if len(v) > 1)[:2]
    n, k, second = 40_000, F.col("id") % 40_000, F.col("id") >= 40_000
    table = spark.range(2 * n).select(
        F.col("id").alias("sale_row"),
        F.when(second, 2).otherwise(1).cast("bigint").alias("load_id"),
        F.when(k % 3 == 0, F.when(second, 101).otherwise(100)).otherwise(200).cast("decimal(38,2)").alias("amount"),
        F.when(k % 5 == 0, F.when(second, other).otherwise(one)).otherwise("EU").alias("region"),
        F.lit(True).alias("paid"),
    )
    checked = quality.LoadQuality(table, spark.createDataFrame([(1, "s"), (2, "s")], LOADS))
    got = {tuple(r) for r in checked.findings().collect()}
    assert got == {(2, "amount", "distribution"), (2, "region", "distribution"), (1, "region", "out_of_limits"), (2, "region", "out_of_limits")}
    beside = {(r.load_id, r.column_name, r.finding): r.told_apart for r in checked.report().collect()}
    assert beside == {x: None if x[0] == 1 else False for x in got}


def test_classifier():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 4, 4000)
    y = rnd.random(4000) < np.where(x == 0, 0.8, 0.4)
    other, fold = rnd.integers(0, 3, 4000), rnd.integers(0, 2, 4000)
    got = shift_test.discriminate({"a": [x], "b": [other]}, fold, (~y).astype(float), y.astype(float))
    assert got["only_a"] > 0.6 and abs(got["only_b"] - 0.5) < 0.04 and got["all"] - got["without_a"] > 0.1
    assert shift_test.auc(np.array([1.0, 2.0]), np.array([1.0, 0.0]), np.array([0.0, 1.0])) == 1.0
    assert shift_test.cross_fitted([np.array([0])], np.array([0]), np.array([5.0]), np.array([0.0])) == 0.5


def test_largest_gap_within_a_bin(spark):
    """Values so close that they share a bin: the gap is found value by value."""
    from decimal import Decimal as D

    a = lambda k: (D("100.00") if k % 2 else D("100.02"), "EU", True)
    b = lambda k: (D("100.00") if k % 10 == 0 else D("100.02"), "EU", True)
    loads = spark.createDataFrame([(1, "s"), (2, "s")], LOADS)
    got = {tuple(r) for r in quality.LoadQuality(sales(spark, {1: (400, a), 2: (400, b)}), loads)._cumulative_change().collect()}
    assert got == {(2,)}


@pytest.mark.parametrize("bucket", [None, "t div 10"])
def test_asof_and_interval(spark, bucket):
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    left = [(i, rnd.choice("ab"), rnd.randrange(60)) for i in range(80)]
    right = sorted({(rnd.choice("abc"), rnd.randrange(60)) for _ in range(25)})
    l, r = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame([(k, t, t * 10) for k, t in right], "k string, t int, v int")
    got = {x.id: x.asof_v for x in joins.asof_join(l, r, ["k"], "t", ["v"], bucket=F.expr(bucket) if bucket else None).collect()}
    assert got == {i: max((t * 10 for k2, t in right if k2 == k and t <= at), default=None) for i, k, at in left}
    spans = spark.createDataFrame([("a", 5, 30), ("b", 0, 7), ("a", 9, 9)], "k string, s int, e int")
    n = joins.interval_join(l, spans, ["k"], "t", "s", "e", 7).count()
    assert n == sum(k == "a" and 5 <= t < 30 or k == "b" and 0 <= t < 7 for _, k, t in left)


@pytest.mark.parametrize("n", [400, 40_000])
def test_amounts_within_a_cell_are_found_at_every_size(spark, n):
    """Disjoint amounts that lie in one cell of the classifier: it is left at chance, but the cell leaves the change open."""
    sales = spark.range(2 * n).selectExpr(
        "id AS sale_row", "1 + id % 2 AS load_id", "CAST(CASE WHEN id % 2 = 0 THEN 100.00 ELSE 101.00 END + (id % 99) / 100 AS decimal(38,2)) AS amount", "'EU' AS region", "true AS paid"
    )
    loads = spark.createDataFrame([(1, "s"), (2, "s")], "load_id bigint, source string")
    got = quality.LoadQuality(sales, loads).report().collect()
    assert [(r.load_id, r.column_name, r.finding) for r in got] == [(2, "amount", "distribution")] and got[0].open
    if n > 1000:
        assert not got[0].told_apart


def test_bounds_hold_whatever_lies_within_the_cells():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.normal(0, 1, rng.integers(1, 60)), rng.normal(rng.random(), 1, rng.integers(1, 60))
        bins = np.floor(np.r_[b, a] * rng.choice([0.5, 1, 3])).astype(np.int64)
        n0, n1 = np.r_[np.ones(len(b)), np.zeros(len(a))], np.r_[np.zeros(len(b)), np.ones(len(a))]
        grid = np.sort(np.r_[a, b])
        gap = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
        assert gap <= quality.widest_gap(bins, n0, n1) + 1e-12
        classes = rng.integers(0, 5, len(bins))
        groups = quality.quantile_groups(bins, n0, n1)
        assert (np.diff(groups[np.argsort(bins, kind="stable")]) >= 0).all() and len(groups) == len(bins)
        p, q = (np.bincount(c, minlength=5)[1:] / max(1, (c > 0).sum()) for c in (classes[len(b) :], classes[: len(b)]))
        if p.sum() and q.sum():
            assert abs(quality.widest_distance(classes, n0, n1) - np.abs(p - q).sum() / 2) < 1e-12
            assert quality.widest_distance(classes, n0, n1, classes > 2) >= np.abs(p - q).sum() / 2 - 1e-12
