"""Queries on evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import leaks
from quarrymill.session import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 25 consecutive words of an item's prompt or solution."""
    got = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), alike=False)
    return got.where("passage").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents with an equal passage, and with one that is alike (similarity of shingles 0.8 or more)."""
    got = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return got.groupBy("item_id").agg(F.count_if("passage").alias("documents_equal"), F.count("*").alias("documents_alike"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}

_W = 25
ORACLE = {
    "p7_found": rf"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(lower(regexp_replace(t, '[^\x00-\x7f]', ' ', 'g')), '[a-z0-9]+') AS w
    FROM (SELECT item_id, prompt AS t FROM eval_items UNION ALL SELECT item_id, solution FROM eval_items)
), doc_words AS (
    SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g').lower(), '[a-z0-9]+') AS w FROM documents
), item_windows AS (
    SELECT DISTINCT item_id, w[k : k + {_W - 1}] AS x, w[k] AS a, w[k + {_W // 2}] AS b, w[k + {_W - 1}] AS c
    FROM (SELECT item_id, w, unnest(range(1, len(w) - {_W - 2})) AS k FROM item_words)
), places AS (
    SELECT doc_id, k, w[k] AS a, w[k + {_W // 2}] AS b, w[k + {_W - 1}] AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_W - 2})) AS k FROM doc_words)
), hits AS (SELECT DISTINCT doc_id, k, item_id, x FROM places JOIN item_windows USING (a, b, c))
SELECT DISTINCT doc_id, item_id FROM hits JOIN doc_words USING (doc_id) WHERE w[k : k + {_W - 1}] = x"""
}
