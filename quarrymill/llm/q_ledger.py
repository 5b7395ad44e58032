"""Queries on duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import ledger
from quarrymill.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every feed row that copies an earlier one, with the row that is kept."""
    rows, book = ledger.build(table(spark, d, "sales_feed"), "feed_row", "record", "received_at")
    return ledger.copies(rows, book)


def p5_folded(spark: SparkSession, d: str) -> DataFrame:
    """One record per group of copies with the number of its copies."""
    feed = table(spark, d, "sales_feed")
    _, book = ledger.build(feed, "feed_row", "record", "received_at")
    return ledger.folded(feed, book, "feed_row", "record")


QUERIES = {"p5_found": p5_found, "p5_folded": p5_folded}

_LABEL = {
    "orderid": "order[\\s_.-]*id",
    "customeremail": "customer[\\s_.-]*email",
    "region": "region",
    "amount": "amount",
    "orderdate": "order[\\s_.-]*date",
    "paid": "paid",
}
_ANY = "|".join(_LABEL.values())


def _field(label: str) -> str:
    pairs = rf"(?is)(?:^|[;|\t\[({{<])\s*{_LABEL[label]}\s*[=:](.*?)(?:[;|\t]\s*(?:{_ANY})\s*[=:]|$)"
    quoted = rf'(?is)"{_LABEL[label]}"\s*:\s*"((?:[^"\\]|\\.)*)"'
    pick = f"CASE WHEN is_json THEN CAST('\"' || regexp_extract(record, '{quoted}', 1) || '\"' AS JSON) ->> '$' ELSE regexp_extract(record, '{pairs}', 1) END"
    return f"lower(regexp_replace({pick}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


_SQL = f"""
WITH parsed AS (SELECT feed_row, record, starts_with(ltrim(record), '{{') AS is_json FROM sales_feed),
keyed AS (SELECT feed_row, record, concat_ws(chr(1), {', '.join(_field(x) for x in _LABEL)}) AS k FROM parsed),
groups AS (SELECT feed_row, record, min(feed_row) OVER (PARTITION BY k) AS keep_row, count(*) OVER (PARTITION BY k) AS copies FROM keyed)
"""
ORACLE = {
    "p5_found": _SQL + "SELECT keep_row, feed_row AS copy_row FROM groups WHERE feed_row <> keep_row",
    "p5_folded": _SQL + "SELECT feed_row, record, copies FROM groups WHERE feed_row = keep_row",
}
