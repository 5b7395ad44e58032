"""CSV and TSV with a strict grammar and dense record numbers.

Files without a double quote are split by lines and read by all tasks at once: records are numbered from counts per
partition. A file with quotes may hold line ends inside cells and cannot be split safely; one task streams it and
the rows are spread afterwards. Both ways give the same rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.errors import SourceError
from quarrymill.model import ROW
from quarrymill.operators.rejects import WHITESPACE
from quarrymill.operators.validate import PROBLEM
from quarrymill.sources.preflight import SourceInfo, check_header, sniff_delimiter

csv.field_size_limit(1 << 30)
BAD_BYTES = "the file's bytes do not fit its encoding"
CHUNK = 20_000


def _reader(path: str, encoding: str, delimiter: str) -> Iterator[list[str]]:
    try:
        with open(path, encoding=encoding, newline="") as f:
            yield from csv.reader(f, delimiter=delimiter, strict=True)
    except UnicodeDecodeError:
        raise SourceError(BAD_BYTES) from None
    except csv.Error:
        raise SourceError("the file's quoting is broken") from None


def header(info: SourceInfo, delimiter: str | None = None) -> list[str]:
    """Sets the delimiter and the column names from the first record."""
    try:
        with open(info.path, encoding=info.encoding, newline=None) as f:
            line = next((x for x in f if x.strip("\r\n")), "")
    except UnicodeDecodeError:
        raise SourceError(BAD_BYTES) from None
    if delimiter:
        info.delimiter = delimiter
    elif info.format == "tsv":
        info.delimiter = "\t"
    else:
        info.delimiter, warning = sniff_delimiter(line)
        info.warnings += [warning] if warning else []
    first = next((r for r in _reader(info.path, info.encoding, info.delimiter) if r), None)
    if first is None:
        raise SourceError("the file holds no record")
    info.columns = check_header(first)
    return info.columns


def _problem(n: int, width: int) -> str:
    return f"expected {width} fields, got {n}"


def read(spark: SparkSession, info: SourceInfo, delimiter: str | None = None, partitions: int | None = None) -> DataFrame:
    """_row, _problem, one text column per header name."""
    names = header(info, delimiter)
    lines = spark.read.option("encoding", "UTF-8").text(info.path)
    plain = info.encoding.lower().replace("_", "-") in ("utf-8", "utf-8-sig") and not lines.where(
        F.col("value").contains('"') | F.col("value").contains("�")
    ).limit(1).count()
    out = _parallel(spark, info, names, lines) if plain else _streamed(spark, info, names)
    return out.repartition(partitions) if partitions else out


def _columns(names: list[str], cells, problem):
    return [problem.alias(PROBLEM), *(F.when(problem.isNull(), F.btrim(cells[k], F.lit(WHITESPACE))).alias(n) for k, n in enumerate(names))]


def _parallel(spark: SparkSession, info: SourceInfo, names: list[str], lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("value", "^﻿", "")
    kept = lines.select(text.alias("value"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).where("value <> ''")
    # a count per partition (bounded by their number) turns positions into dense record numbers; the header is record 0
    sizes = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, start = 0, {}
    for p in sorted(sizes):
        start[p] = before
        before += sizes[p]
    firsts = spark.createDataFrame(sorted(start.items()), "part int, start bigint") if start else spark.createDataFrame([], "part int, start bigint")

    def number(batches: Iterable) -> Iterator:
        import pyarrow as pa

        seen: dict[int, int] = {}
        for b in batches:
            part, first = b.column(1).to_pylist(), b.column(2).to_pylist()
            rows = []
            for p, s in zip(part, first):
                k = seen.get(p, 0)
                seen[p] = k + 1
                rows.append(s + k)
            yield pa.record_batch([pa.array(rows, pa.int64()), b.column(0)], names=[ROW, "value"])

    numbered = kept.join(F.broadcast(firsts), "part").select("value", "part", "start").mapInArrow(number, f"{ROW} bigint, value string")
    pattern = {"|": r"\|", "\t": "\t"}.get(info.delimiter, info.delimiter)
    cells = F.split("value", pattern, -1)
    n = F.size("cells")
    problem = F.when(n != len(names), F.concat(F.lit("expected "), F.lit(len(names)), F.lit(" fields, got "), n.cast("string")))
    out = numbered.where(f"{ROW} > 0").select(ROW, cells.alias("cells"))
    return out.select(ROW, *_columns(names, F.col("cells"), problem))


def _streamed(spark: SparkSession, info: SourceInfo, names: list[str]) -> DataFrame:
    path, encoding, delimiter, width = info.path, info.encoding, info.delimiter, len(names)

    def stream(_: Iterable) -> Iterator:
        import pyarrow as pa

        for _batch in _:
            rows: list[tuple] = []
            number = -1
            for record in _reader(path, encoding, delimiter):
                if not record:
                    continue
                number += 1
                if number == 0:
                    continue
                rows.append((number, record) if len(record) == width else (number, [_problem(len(record), width)]))
                if len(rows) == CHUNK:
                    yield _batch_of(rows, width, pa)
                    rows = []
            if rows:
                yield _batch_of(rows, width, pa)

    schema = f"{ROW} bigint, problem string, cells array<string>"
    raw = spark.range(1).coalesce(1).mapInArrow(stream, schema)
    raw = raw.repartition(max(spark.sparkContext.defaultParallelism, 1))
    return raw.select(ROW, F.col("problem").alias(PROBLEM), *(F.col("cells")[k].alias(n) for k, n in enumerate(names)))


def _batch_of(rows: list[tuple], width: int, pa):
    bad = [len(r) == 1 and width != 1 for _, r in rows]
    return pa.record_batch(
        [
            pa.array([n for n, _ in rows], pa.int64()),
            pa.array([r[0] if b else None for (_, r), b in zip(rows, bad)], pa.string()),
            pa.array([[None] * width if b else [x.strip() for x in r] for (_, r), b in zip(rows, bad)], pa.list_(pa.string())),
        ],
        names=[ROW, "problem", "cells"],
    )


def write_rows(rows: Iterable, names: list[str], out: io.TextIOBase) -> int:
    w = csv.writer(out)
    w.writerow(names)
    n = 0
    for r in rows:
        w.writerow(["" if v is None else v for v in r])
        n += 1
    return n
