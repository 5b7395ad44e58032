"""Coercion: the column expressions agree with the single-value parser, and both with the stated tables."""

import random
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import coerce, plain
from quarrymill.functions.text import name_score, shape, shape_of
from quarrymill.model import Column

LOOKALIKES = {
    "integer": ["007", "1.0", "1e3", "1,000", "abc", "", "0x10", "+", "--1", "٣", "１", " 1"],
    "decimal": ["01234", "007.5", "12,50", "1,000.00", "1e5", "NaN", "Infinity", ".5", "5.", "", "--1", "1.234", "９.5"],
    "date": ["2026-1-5", "2026-02-30", "03/04/2026", "0000-01-01", "2026-01-01 ", "20260101"],
    "boolean": ["2", "maybe", "", "truee", "-1"],
}
GOOD = {
    "integer": ["0", "-5", "+5", "9223372036854775807", "-9223372036854775808"],
    "decimal": ["1.23", "1.230", "-0.00", "+7", "0.5"],
    "date": ["2026-01-05", "0001-01-01", "9999-12-31", "2024-02-29"],
    "boolean": ["TRUE", "f", "Yes", "n", "1", "0"],
}


def column(kind):
    return Column("c", kind, scale=2 if kind == "decimal" else None)


@pytest.mark.parametrize("kind", list(LOOKALIKES))
def test_tables(spark, kind):
    c = column(kind)
    texts = LOOKALIKES[kind] + GOOD[kind]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.p for r in rows.select("i", coerce.coerce(F.col("t"), c).alias("p")).orderBy("i").collect()]
    for text, p in zip(texts, got):
        value, error = c.parse(text)
        assert (p["value"], p["error"]) == (value, error), text
        assert (error is None) == (text in GOOD[kind])


def test_messages():
    assert plain.parse("integer", "007")[1].startswith("leading zeros")
    assert plain.parse("integer", str(2**63))[1] == "integer out of 64-bit range"
    assert plain.parse("decimal", "9" * 39, scale=2)[1] == "decimal too large"
    assert plain.parse("decimal", "1.555", scale=2)[1] == "more than 2 decimal places (would require rounding)"
    assert plain.parse("date", "2026-1-5")[1] == "date not in canonical form for format %Y-%m-%d"


def test_random_texts_agree(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("0123456789+-.,e ") for _ in range(rnd.randrange(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("integer", "decimal"):
        c = column(kind)
        for r in rows.select("t", coerce.coerce(F.col("t"), c).alias("p")).collect():
            assert (r.p["value"], r.p["error"]) == c.parse(r.t), (kind, r.t)


@settings(max_examples=200, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=2, min_value=-(10**20), max_value=10**20))
def test_decimal_round_trip(x):
    value, error = plain.parse("decimal", format(x, "f"), scale=2)
    assert error is None and value == Decimal(x)


def test_other_date_formats(spark):
    rows = spark.createDataFrame([("05.01.2026", "05 Jan 2026"), ("5.1.2026", "x"), ("31.02.2026", "31 Feb 2026")], "a string, b string")
    got = rows.select(coerce.date(F.col("a"), "%d.%m.%Y").alias("a"), coerce.date(F.col("b"), "%d %b %Y").alias("b")).collect()
    assert [g.a["value"] is not None for g in got] == [True, False, False]
    assert got[1].a["error"].startswith("date not in canonical form") and got[2].a["error"].startswith("not a valid date")
    assert [g.b["value"] is not None for g in got] == [True, False, False]


def test_formula_guard(spark):
    from quarrymill.plans.outputs import csv_safe

    cells = ["=1+1", "@SUM(A1)", "+cmd|x", "-1+2", "+49 (0) 30-1234", "-12", "plain", ""]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(coerce.formula_guard(F.col("c")).alias("g"))
    got = [r.g for r in rows.collect()]
    assert got == [csv_safe(c) for c in cells]
    assert [g.startswith("'") for g in got] == [True] * 4 + [False] * 4


def test_shapes(spark):
    cells = ["Ab12-c", "AB 123456", "ünïcode", "x" * 100, "a\tb", "", "日本7", "1", "a1b22", "x\u00a0y", "a\x01b", "line\nend", "½", "7" * 70]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(shape(F.col("c")).alias("s")).collect()
    assert [r.s for r in rows] == [shape_of(c) for c in cells]
    assert shape_of("Ab12-c") == "A+a+9{2}-a+" and shape_of("a1\tb") == "a+9 a+"
    assert all(not re.search("[b-zB-KM-Z]", s.replace("?", "")) for s in (shape_of(c) for c in cells))


def test_name_score():
    assert name_score("Order No", "order_id") == 1.0
    assert name_score("Buyer Email", "customer_email") == 1.0
    assert name_score("colour", "order_date") == 0.0
