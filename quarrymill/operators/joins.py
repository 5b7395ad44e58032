"""Joins that Spark SQL lacks: as-of and interval joins without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], prefix: str = "asof_", bucket: Column | None = None) -> DataFrame:
    """Every left row with the values of the latest right row of the same key at or before its time (null if none).

    Both sides are put on one line per key and the last right row is carried forward, so no pair is formed. Keys so hot that
    one task cannot sort them are divided by ``bucket`` (a rising expression over the columns of both sides, for instance the day): values are carried within
    buckets first, and what a bucket begins with comes from the last right row of the buckets before.
    Ties: a right row at the same time counts as before; of several, the one greatest by its values wins.
    """
    part = bucket if bucket is not None else F.lit(0)
    names = [c for c in left.columns]
    own = left.select(*by, F.col(time).alias("_t"), F.struct(*(F.col(c) for c in names)).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_right"), part.alias("_part"), F.lit(1).alias("_side"))
    other = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"), part.alias("_part"), F.lit(0).alias("_side"))
    line = own.unionByName(other)
    w = Window.partitionBy(*by, "_part").orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = line.withColumn("_found", F.last("_right", ignorenulls=True).over(w))
    if bucket is not None:
        last = other.groupBy(*by, "_part").agg(F.max(F.struct("_t", "_right")).alias("m")).select(*by, "_part", F.col("m._right").alias("_end"))
        parts = own.select(*by, "_part").distinct().join(last, [*by, "_part"], "full_outer")
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        begin = parts.withColumn("_begin", F.last("_end", ignorenulls=True).over(before)).select(*by, "_part", "_begin")
        carried = carried.where("_side = 1").join(begin, [*by, "_part"], "left").withColumn("_found", F.coalesce("_found", "_begin"))
    return carried.where("_side = 1").select("_left.*", *(F.col("_found")[v].alias(f"{prefix}{v}") for v in values))


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the spans that hold them (start <= at < end), as an equi-join on buckets of ``width`` units of ``at``.

    A span is repeated once per bucket it touches; choose the width near the usual span. Columns of both sides must differ but for ``by``.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, [*by, "_bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bucket")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group; Spark limits each group before the shuffle, so a hot group sends k rows per task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
