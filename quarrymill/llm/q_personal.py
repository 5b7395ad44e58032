"""Queries on personal information inside free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import personal
from quarrymill.session import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold personal information, per kind."""
    return personal.Bootstrap(table(spark, d, "documents")).places()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts with typed placeholders."""
    return personal.Bootstrap(table(spark, d, "documents"), keep=True).redacted()


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE: dict[str, str] = {}
