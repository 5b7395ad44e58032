"""Queries on filling containers of fixed capacity with texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import packing
from quarrymill.session import table, write_once


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return packing.token_counts(table(spark, d, "documents"), "doc_id", "text")


def _capacities(spark: SparkSession, d: str) -> list[int]:
    """All capacities asked for; every one of them repeats the whole result, so there are few."""
    return [r[0] for r in table(spark, d, "containers").select("capacity_tokens").distinct().collect()]


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return packing.place_all(_counts(spark, d), _capacities(spark, d))


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """The container and place of every text, or of its parts where it is longer than the capacity."""
    return _placed(spark, d).withColumnRenamed("item", "doc_id")


def p6_use(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.use(_placed(spark, d))


def p6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """The size of every text in tokens."""
    return _counts(spark, d).select(F.col("item").alias("doc_id"), "n_tokens")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """How often the result of p6_placed breaks a rule of packing, per capacity."""
    counts = write_once(_counts(spark, d), "counts")
    placed = write_once(packing.place_all(counts, _capacities(spark, d)), "placed")
    return packing.invariants(placed, counts)


QUERIES = {"p6_placed": p6_placed, "p6_use": p6_use, "p6_token_counts": p6_token_counts, "p6_invariants": p6_invariants}
ORACLE = {
    "p6_invariants": """SELECT c.capacity_tokens, d.texts, 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS incomplete,
        0::BIGINT AS split_wrongly, true AS tight FROM (SELECT DISTINCT capacity_tokens FROM containers) c, (SELECT count(*) AS texts FROM documents) d"""
}
