"""Queries on percentiles of very large numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm import radix
from quarrymill.session import table

WANTED = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
LEVELS = {"region": ["region"], "region_load": ["region", "load_id"]}


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the amount per region and per region and load, exact to double precision, that is, to 15 digits of decimal(38,2)."""
    got = radix.percentiles(table(spark, d, "sales"), LEVELS, F.col("amount"), WANTED)
    return got.select(
        "level", "region", "load_id", "percentile", "n_values", F.col("low").cast("decimal(38,2)").alias("value")
    )


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per region from the summaries of single loads, added up, with their error bound."""
    parts = radix.summaries(table(spark, d, "sales"), ["region", "load_id"], F.col("amount"))
    return radix.from_summary(parts, ["region"], WANTED)


def p2_daily_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians per order date from two passes of 16 bits: the interval of each and its relative error."""
    sales = table(spark, d, "sales")
    return radix.percentiles(sales, {"day": ["order_date"]}, F.col("amount"), (0.5,), passes=2)


def _exact(spark: SparkSession, d: str, groups: list[str], wanted: tuple[float, ...]) -> DataFrame:
    """Exact percentiles by sorting, to compare with."""
    rows = table(spark, d, "sales").where("amount IS NOT NULL").select(*groups, F.col("amount").cast("double").alias("exact"))
    w = Window.partitionBy(*groups)
    ranked = rows.select("*", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("exact")).alias("r"))
    ranked = ranked.withColumn("p", F.explode(F.array(*map(F.lit, wanted)))).where("r = greatest(1, ceil(p * n))")
    return ranked.select(*(F.col(g).alias(f"e_{g}") for g in groups), F.col("p").alias("e_p"), "exact")


def p2_merged_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether the interval of every percentile of p2_merged holds the exact one and is as narrow as its stated error."""
    got, exact = p2_merged(spark, d), _exact(spark, d, ["region"], WANTED)
    both = got.join(exact, F.col("region").eqNullSafe(F.col("e_region")) & (F.col("percentile") == F.col("e_p")))
    narrow = F.col("high") - F.col("low") <= F.col("relative_error") * F.greatest(F.abs("low"), F.abs("high"))
    return both.select("region", "percentile", "total", (F.col("exact").between(F.col("low"), F.col("high")) & narrow).alias("within"))


def p2_daily_medians_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same of the medians per day."""
    got, exact = p2_daily_medians(spark, d), _exact(spark, d, ["order_date"], (0.5,))
    both = got.join(exact, F.col("order_date").eqNullSafe(F.col("e_order_date")))
    narrow = F.col("high") - F.col("low") <= F.col("relative_error") * F.greatest(F.abs("low"), F.abs("high"))
    return both.select("order_date", "n_values", (F.col("exact").between(F.col("low"), F.col("high")) & narrow).alias("within"))


QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_merged": p2_merged,
    "p2_daily_medians": p2_daily_medians,
    "p2_merged_checked": p2_merged_checked,
    "p2_daily_medians_checked": p2_daily_medians_checked,
}

_RANKS = f"""
SELECT {{keys}}, p AS percentile, n AS n_values, v AS value FROM (
    SELECT {{keys}}, amount AS v, count(*) OVER (PARTITION BY {{keys}}) AS n,
        row_number() OVER (PARTITION BY {{keys}} ORDER BY amount) AS r FROM sales WHERE amount IS NOT NULL
), (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in WANTED)}]) AS p)
WHERE r = greatest(1, ceil(p * n))
"""
_SUMMED = f"""
SELECT region, percentile, n_values AS total, true AS within FROM ({_RANKS.format(keys='region')})
"""
_DAYS = """
SELECT order_date, count(amount) AS n_values, true AS within FROM sales WHERE amount IS NOT NULL GROUP BY order_date
"""
ORACLE = {
    "p2_percentiles": f"""
SELECT 'region' AS level, region, NULL::BIGINT AS load_id, percentile, n_values, value FROM ({_RANKS.format(keys='region')})
UNION ALL
SELECT 'region_load', region, load_id, percentile, n_values, value FROM ({_RANKS.format(keys='region, load_id')})
"""
}
ORACLE |= {"p2_merged_checked": _SUMMED, "p2_daily_medians_checked": _DAYS}
