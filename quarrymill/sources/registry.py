"""One entry to all sources, and the synthetic one."""

from __future__ import annotations

import csv
import random
from datetime import date, timedelta
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.errors import SourceError
from quarrymill.model import ROW
from quarrymill.operators.validate import PROBLEM
from quarrymill.session import spread
from quarrymill.sources import delimited, documents
from quarrymill.sources.preflight import ENCODING, SourceInfo, inspect


def read_source(
    spark: SparkSession,
    path: str,
    *,
    max_bytes: int | None = None,
    fmt: str | None = None,
    encoding: str | None = None,
    delimiter: str | None = None,
    table: str | None = None,
    records_path: str | None = None,
    max_memory_bytes: float | None = None,
) -> tuple[DataFrame, SourceInfo]:
    """(raw frame, facts about the file). The raw frame has _row, _problem and a text column per source column."""
    info = inspect(path, max_bytes, fmt)
    info.encoding = encoding or ENCODING
    if info.format in ("csv", "tsv"):
        raw = delimited.read(spark, info, delimiter)
    elif info.format == "json":
        raw = documents.read_json(spark, info, records_path, max_memory_bytes)
    elif info.format == "jsonl":
        raw = documents.read_lines(spark, info)
    elif info.format == "sql":
        raw = documents.read_dump(spark, info, table, max_memory_bytes)
    else:
        raise SourceError("unknown format")
    return raw, info


def read_table(df: DataFrame, order: str) -> DataFrame:
    """A raw frame of an existing table: all columns as text, records numbered in the order of a unique column."""
    texts = [F.when(F.col(c).isNotNull(), F.col(c).cast("string")).alias(c) for c in df.columns]
    return spread(df).select(F.col(order).cast("bigint").alias(ROW), F.lit(None).cast("string").alias(PROBLEM), *texts)


#: Values of the invented buyers (fixed values).
COUNTRIES = ("AT", "BE", "CZ", "DE", "DK", "ES", "FI", "FR", "IE", "IT", "NL", "PL", "PT", "SE")
AGES = ("18-24", "25-34", "35-44", "45-54", "55-64", "65+")
CHANNELS = ("app", "email", "phone", "store", "web")
HEADER = (
    "buyer_id", "full_name", "email", "country", "age_group", "preferred_category", "preferred_channel", "preference_score", "monthly_budget",
    "last_purchase_date", "newsletter", "notes",
)


def generate_buyers(path: str, rows: int, bad_percent: float = 0.5, seed: int = 1, megabytes: float | None = None) -> int:
    """Writes invented buyers with a share of deliberate errors of six kinds; returns the number of rows.

    With ``megabytes`` rows are written until the file is that large, whatever ``rows`` says.
    """
    rnd, previous = random.Random(seed), 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        for i in count(1):
            if i > rows if megabytes is None else f.tell() >= megabytes * (1 << 20):
                return i - 1
            r = [
                i, f"Buyer {i:07d}", f"buyer{i}@mail{i % 7}.example", rnd.choice(COUNTRIES), rnd.choice(AGES), f"category_{rnd.randrange(10)}", rnd.choice(CHANNELS),
                f"{rnd.randrange(10_001) / 100:.2f}", f"{rnd.randrange(200_000) / 100:.2f}", (date(2024, 1, 1) + timedelta(rnd.randrange(700))).isoformat(),
                rnd.choice(("true", "false")), rnd.choice(("", "prefers, commas", 'says "hello"', "two\nlines", "привіт")),
            ]
            if rnd.random() * 100 < bad_percent:
                kind = rnd.randrange(6)
                if kind == 5 and previous:
                    r[0] = previous
                else:
                    at, value = ((5, "unknown"), (8, "-5.00"), (9, "03/04/2026"), (7, "101.00"), (2, "not-an-email"))[kind % 5]
                    r[at] = value
            previous = r[0]
            w.writerow(r)
