"""Percentiles, distinct counts and the ledger against exact answers on small data."""

import json
import math
import random
import statistics
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import ledger, radix, setsketch

ODD = [0.0, -0.0, 1.5, -1.5, 1e-310, -1e-310, 5e-324, 1e308, float("inf"), float("-inf"), 2.0**52, 1 / 3, 7.25, -7.25]


def test_keys_keep_the_order_and_come_back(spark):
    rnd = random.Random(1)
    values = ODD + [rnd.uniform(-1e6, 1e6) for _ in range(300)] + [rnd.lognormvariate(0, 30) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    df = radix.with_key(df, "v", "k")
    rows = df.select("v", "k", radix.value_of(F.col("k")).alias("back")).collect()
    assert all(r.back == r.v for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(r.v for r in rows)


def exact(values, p):
    s = sorted(v for v in values if v is not None and not math.isnan(v))
    return s[max(1, math.ceil(p * len(s))) - 1]


def test_percentiles(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), rnd.choice([None, float("nan"), rnd.lognormvariate(3, 2), -5.0, 7.0])) for _ in range(900)]
    rows += [("only", 1, None)]
    df = spark.createDataFrame(rows, "g string, d int, v double").withColumn("prefix", F.lit("x"))
    wanted = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = radix.percentiles(df, {"g": ["g"], "gd": ["g", "d"]}, F.col("v"), wanted).collect()
    for r in got:
        own = [v for g, d, v in rows if g == r.g and (r.level == "g" or d == r.d)]
        assert r.low == r.high == exact(own, r.percentile)
    assert len(got) == 5 * 3 + 5 * 9
    rough = radix.percentiles(df, {"g": ["g"]}, F.col("v"), wanted, passes=2).collect()
    for r in rough:
        x = exact([v for g, d, v in rows if g == r.g], r.percentile)
        assert r.low <= x <= r.high and r.high - r.low <= abs(x) * r.relative_error + 1e-300
    merged = radix.from_summary(radix.summaries(df, ["g", "d"], F.col("v")), ["g"], wanted).collect()
    for r in merged:
        x = exact([v for g, d, v in rows if g == r.g], r.percentile)
        assert r.low <= x <= r.high and abs(r.value - x) <= abs(x) * r.relative_error
    assert radix.percentiles(df.where("false"), {"g": ["g"]}, F.col("v"), wanted).count() == 0


def test_distinct_counts(spark):
    rows = [(f"d{i % 3}", f" User{i % n}@X ") for n in (50, 3000) for i in range(6000)] + [("none", None), (None, "a"), (None, "A ")]
    df = spark.createDataFrame(rows, "g string, e string").withColumn("register", F.lit(1))
    sketches = setsketch.registers(df, ["g"], F.col("e"), m=1024)
    got = {r.g: r for r in setsketch.estimates(sketches, ["g"], m=1024).collect()}
    for g, r in got.items():
        true = len({e.strip().lower() for x, e in rows if x == g and e is not None})
        assert abs(r.estimate - true) <= max(0.5, 4 * r.standard_error), (g, true, r)
    assert got["none"].estimate == 0 and abs(got[None].estimate - 1) < 0.1
    whole = setsketch.estimates(setsketch.merge(sketches, []), [], m=1024).first()
    direct = setsketch.estimates(setsketch.registers(df, [], F.col("e"), m=1024), [], m=1024).first()
    assert whole.estimate == direct.estimate
    assert setsketch.estimates(setsketch.registers(df.where("false"), ["g"], F.col("e")), ["g"]).count() == 0


def test_stated_error_holds_over_many_sets():
    rnd, m, base, z = np.random.default_rng(4), 512, 1.05, []
    for _ in range(60):
        n = 2000
        at, u = rnd.integers(0, m, n), rnd.random(n)
        k = np.floor(-np.log(u) / math.log(base)).astype(int) + 1
        regs = np.zeros(m, int)
        np.maximum.at(regs, at, k)
        est, err = setsketch.estimate_one(regs[regs > 0], m, base)
        z.append((est - n) / err)
    assert abs(statistics.mean(z)) < 0.5 and 0.7 < statistics.pstdev(z) < 1.35


def test_joint_estimates():
    rnd, m, base, errors = np.random.default_rng(6), 1024, 1.05, []
    for both in (0, 500, 3000):
        n = 4000
        ids = 2 * n - both
        at, k = rnd.integers(0, m, ids), np.floor(-np.log(rnd.random(ids)) / math.log(base)).astype(int) + 1
        left, right = np.zeros(m, int), np.zeros(m, int)
        np.maximum.at(left, at[:n], k[:n])
        np.maximum.at(right, at[n - both :], k[n - both :])
        got = setsketch.estimate_joint(left, right, m, base)
        errors.append(abs(got["jaccard"] - both / ids) / max(got["jaccard_error"], 1e-9))
        assert abs(got["either"] - ids) < 0.15 * ids
    assert max(errors) < 4.5
    none = setsketch.estimate_joint(np.zeros(0, int), np.zeros(0, int), m, base)
    assert none["either"] == 0 and none["jaccard"] == 0


def test_canonical_text(spark):
    same = [
        '{"order_id": "40,1", "customer_email": "A@b.example", "region": "EU", "amount": "12.50", "order_date": "2026-01-05", "paid": "true"}',
        "[PAID: TRUE ;Order Date:2026/01/05; Amount: 12,50 | REGION : e.u.|order-id=  #401; CustomerEmail=a @ b.example;]",
        "region=(EU)\tamount=12.50\torder_id=401\tpaid=true\tcustomer_email=a@b.example\torder_date=20260105\t",
    ]
    other = [same[2].replace("12.50", "12.5"), None, "", "nothing here", '{"a": 1']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(same + other)], "i int, r string")
    got = [r.k for r in rows.select("i", ledger.canonical_text(F.col("r")).alias("k")).orderBy("i").collect()]
    assert len(set(got[:3])) == 1 and got[3] != got[0] and set(got[4:]) == {""}


def test_ledger(spark):
    rnd = random.Random(3)
    keys = [rnd.choice(["hot", "hot", *map(str, range(40))]) for _ in range(600)]
    rows = [(i * 3, datetime(2026, 1, 1 + i % 28), json.dumps({"order_id": k, "paid": rnd.choice(["true", " TRUE"])}), i) for i, k in enumerate(keys)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "feed_row bigint, received_at timestamp_ntz, record string, key int")
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i * 3)
    for batches in (1, 4):
        keyed, book = ledger.build(df, "feed_row", "record", "received_at", batches=batches)
        got = sorted(tuple(r) for r in ledger.copies(keyed, book).collect())
        assert got == sorted((first[k], i * 3) for i, k in enumerate(keys) if first[k] != i * 3)
        assert {r.feed_row: r.copies for r in ledger.folded(df, book, "feed_row", "record").collect()} == {f: keys.count(k) for k, f in first.items()}
    none, book = ledger.build(df.where("false"), "feed_row", "record", "received_at")
    assert ledger.copies(none, book).count() == 0


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ledger, "HOT_SHARE", 1)
    df = spark.createDataFrame([(i, f"order_id={min(i, 20_000)}") for i in range(40_000)], "feed_row bigint, record string")
    keyed, book = ledger.build(df, "feed_row", "record")
    real = ledger.max if hasattr(ledger, "max") else max
    monkeypatch.setattr(ledger, "max", lambda a, b: real(min(a, 10_000), 0), raising=False)
    assert ledger.copies(keyed, book).count() == 19_999


def test_every_region_is_set_against_the_others(spark, tmp_path):
    from quarrymill.llm import q_distinct

    rows = [(r, f"u{i}") for r, a, b in (("EU", 0, 400), ("US", 300, 600), ("x", 0, 40), (None, 590, 700)) for i in range(a, b)]
    spark.createDataFrame(rows, "region string, customer_email string").selectExpr("date'2026-01-01' AS order_date", "*").write.parquet(f"{tmp_path}/sales.parquet")
    got = {r.left_region: r for r in q_distinct.p3_joint_regions(spark, str(tmp_path)).collect() if r.right_region == "*"}
    assert set(got) == {"EU", "US", "x", None}
    for g, r in got.items():
        own, others = {e for x, e in rows if x == g}, {e for x, e in rows if x != g}
        assert abs(r.left_count - len(own)) < 0.1 * len(own) + 2 and abs(r.right_count - len(others)) < 0.1 * len(others)
        assert abs(r.both - len(own & others)) < 0.1 * len(own | others)


def test_joint_errors_hold_over_many_sets():
    """Deviations of intersection, union and similarity, divided by their stated errors, are of the size of one."""
    rng, m, base = np.random.default_rng(4), 1024, 1.05
    for a, b, c in ((9000, 4000, 3000), (500, 500, 500), (40, 10, 5), (3000, 0, 600)):
        z = []
        for _ in range(25):
            n = a + b + c
            reg, val = rng.integers(0, m, n), np.floor(-np.log(rng.random(n)) / np.log(base)).astype(int) + 1
            left, right = np.zeros(m, int), np.zeros(m, int)
            np.maximum.at(left, np.r_[reg[:a], reg[a + b :]], np.r_[val[:a], val[a + b :]])
            np.maximum.at(right, reg[a:], val[a:])
            got = setsketch.estimate_joint(left, right, m, base)
            z.append([(got[k] - true) / max(got[f"{k}_error"], 1e-9) for k, true in (("both", c), ("either", n), ("jaccard", c / n))])
        size = np.sqrt((np.array(z) ** 2).mean(axis=0))
        assert (size < 1.5).all(), (a, b, c, size)
    small = setsketch.estimate_joint(np.array([1]), np.array([0]), m, base)
    assert small["both"] == 0 and small["jaccard"] == 0


def test_registers_of_a_small_base_do_not_overflow(spark):
    df = spark.range(3000).selectExpr("'g' AS g", "CAST(id AS string) AS e")
    sketches = setsketch.registers(df, ["g"], F.col("e"), m=1024, base=1.0005)
    assert sketches.agg(F.max("value")).first()[0] > 1 << 13
    r = setsketch.estimates(sketches, ["g"], m=1024, base=1.0005).first()
    assert abs(r.estimate - 3000) < 4 * r.standard_error < 600


def test_ledger_is_opened_again_and_grows_by_segments(spark, tmp_path):
    """Batches added by separate sessions give what one batch gives; small batches rewrite nothing large; old files are gone."""
    folder = f"file://{tmp_path}/book"
    rows = [(i, f"order_id={i % 300}" if i < 3000 else f"order_id={i % 37}") for i in range(3200)]
    df = ledger.keyed(spark.createDataFrame(rows, "row_id bigint, record string"), "row_id", "record")
    one = ledger.Ledger.open(spark, f"file://{tmp_path}/one")
    one.add(df)
    parts = [df.where("row_id < 3000"), df.where("row_id BETWEEN 3000 AND 3100"), df.where("row_id > 3100")]
    sizes = []
    for part in parts:
        other = spark.newSession()
        book = ledger.Ledger.open(other, folder)
        book.add(part)
        sizes.append([s["rows"] for s in book.segments])
        for name in book._tables.values():
            other.sql(f"DROP TABLE {name}")
    assert sizes == [[300], [300, 37], [300, 37]]
    last = ledger.Ledger.open(spark, folder)
    sort = lambda x: sorted((bytes(r.key), r.copies, r.keep_row) for r in x.entries().collect())
    assert sort(last) == sort(one) and last.version == 3
    plan = last.entries()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert len([x for x in (tmp_path / "book").iterdir() if x.name.startswith("segment")]) == 2
    stale = ledger.Ledger(spark, folder, last.buckets, last.segments, 2)
    with pytest.raises(RuntimeError):
        stale.add(parts[2])
    assert sort(ledger.Ledger.open(spark, folder)) == sort(one)
