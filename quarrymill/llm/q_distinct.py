"""Queries on distinct counts over huge identifier sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm import setsketch
from quarrymill.operators.rejects import WHITESPACE
from quarrymill.session import cut, table

REGION_PAIRS = (("EU", "US"), ("EU", "APAC"), ("US", "APAC"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """The partial results: one sketch per day and region, stored once."""
    sales = table(spark, d, "sales").select("order_date", "region", "customer_email")
    return cut(setsketch.registers(sales, ["order_date", "region"], F.col("customer_email")))


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct buyers' addresses per day, per region, per both and over all, from the sketches per day and region."""
    base = _daily(spark, d)
    levels = {"date_region": ["order_date", "region"], "date": ["order_date"], "region": ["region"], "all": []}
    parts = []
    for level, kept in levels.items():
        merged = base if len(kept) == 2 else setsketch.merge(base, kept)
        parts.append(
            merged.select(
                F.lit(level).alias("level"),
                *(
                    (F.col(g) if g in kept else F.lit(None).cast(base.schema[g].dataType)).alias(g)
                    for g in ("order_date", "region")
                ),
                "value",
            )
        )
    return setsketch.estimates(reduce(DataFrame.unionByName, parts), ["level", "order_date", "region"])


def p3_joint_regions(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and Jaccard similarity of the address sets of the regions: the stated pairs, and every region code (null
    too) against the union of all others (right_region ``*``)."""
    base = cut(setsketch.merge(_daily(spark, d), ["region"]))
    parts = [
        setsketch.pair_up(
            base.where(F.col("region") == a).drop("region"), base.where(F.col("region") == b).drop("region"), []
        ).select(F.lit(a).alias("left_region"), F.lit(b).alias("right_region"), "left_value", "right_value")
        for a, b in REGION_PAIRS
    ]
    parts.append(_against_others(base))
    return setsketch.joint(reduce(DataFrame.unionByName, parts), ["left_region", "right_region"])


def _against_others(base: DataFrame) -> DataFrame:
    """Every region's registers beside the union of all others: the largest value of a register, or the second for its holder."""
    along = Window.partitionBy("register").orderBy(F.desc("value"), "region")
    top = base.where("register >= 0").select("register", "region", "value", F.row_number().over(along).alias("k"), F.lead("value").over(along).alias("next"))
    top = top.where("k = 1").select("register", F.col("region").alias("holder"), F.col("value").alias("most"), "next")
    grid = base.select(F.col("region").alias("left_region")).distinct().crossJoin(top)
    own = base.withColumnRenamed("register", "at")
    both = grid.join(own, F.col("left_region").eqNullSafe(F.col("region")) & (F.col("register") == F.col("at")), "left")
    right = F.when(F.col("left_region").eqNullSafe(F.col("holder")), F.col("next")).otherwise(F.col("most"))
    zero = F.lit(0)
    return both.select("left_region", F.lit("*").alias("right_region"), F.coalesce("value", zero).alias("left_value"), F.coalesce(right, zero).alias("right_value"))


def p3_joint_days(spark: SparkSession, d: str) -> DataFrame:
    """Every day's address set against that of the day before."""
    day = cut(setsketch.merge(_daily(spark, d), ["order_date"])).where("order_date IS NOT NULL")
    before = day.withColumn("order_date", F.date_add("order_date", 1))
    known = day.select("order_date").distinct()
    pairs = setsketch.pair_up(day, before, ["order_date"]).join(known, "order_date", "left_semi")
    return setsketch.joint(pairs, ["order_date"])


def _email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sales").select("order_date", "region", setsketch.identifier(F.col("customer_email")).alias("e"))


def p3_distinct_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per level: groups, the sum of their exact distinct counts, and whether at least 98 % of the estimates lie within three stated errors of the
    exact count (of normal errors 99.7 % do; half an identifier is rounding)."""
    sales, parts = _email(spark, d), []
    for level, kept in (("date_region", ["order_date", "region"]), ("date", ["order_date"]), ("region", ["region"]), ("all", [])):
        own = sales.groupBy(*kept).agg(F.countDistinct("e").alias("exact"))
        parts.append(own.select(F.lit(level).alias("level"), *((F.col(g) if g in kept else F.lit(None).cast(sales.schema[g].dataType)).alias(g) for g in ("order_date", "region")), "exact"))
    exact = reduce(DataFrame.unionByName, parts).withColumnsRenamed({c: f"e_{c}" for c in ("level", "order_date", "region")})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("level", "order_date", "region")))
    near = F.abs(F.col("estimate") - F.col("exact")) <= 3 * F.col("standard_error") + 0.5
    both = exact.join(p3_distinct(spark, d), same, "left")
    return both.groupBy(F.col("e_level").alias("level")).agg(
        F.count("*").alias("groups"), F.sum("exact").alias("exact_total"), (F.count_if(near) >= 0.98 * F.count("*")).alias("within")
    )


def p3_joint_regions_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of p3_joint_regions: exact intersection and union, and whether both estimates and the similarity lie within three stated errors."""
    held = _email(spark, d).where("e IS NOT NULL").select("region", "e").distinct()
    others = held.groupBy("e").agg(F.count("*").alias("holders"))
    known = table(spark, d, "sales").select("region").distinct()
    total = others.agg(F.count("*").alias("all"))
    own = held.join(others, "e").groupBy("region").agg(F.count_if(F.col("holders") > 1).alias("x_both"))
    alone = known.alias("k").join(own.alias("o"), F.col("k.region").eqNullSafe(F.col("o.region")), "left").select(F.col("k.region").alias("x_left"), F.lit("*").alias("x_right"), F.coalesce("x_both", F.lit(0)).alias("x_both"))
    # a region and all others together hold every identifier there is: one number, set beside each row
    parts = [alone.withColumn("x_either", F.lit(total.first()[0]))]
    for a, b in REGION_PAIRS:
        sides = held.where(F.col("region").isin(a, b)).groupBy("e").agg(F.count("*").alias("n"))
        parts.append(sides.agg(F.count_if(F.col("n") == 2).alias("x_both"), F.count("*").alias("x_either")).select(F.lit(a).alias("x_left"), F.lit(b).alias("x_right"), "x_both", "x_either"))
    exact = reduce(DataFrame.unionByName, parts)
    both = exact.join(p3_joint_regions(spark, d), F.col("left_region").eqNullSafe(F.col("x_left")) & (F.col("right_region") == F.col("x_right")), "left")
    near = lambda est, true, error: F.abs(F.col(est) - true) <= 3 * F.col(error) + F.lit(0.5 if est != "jaccard" else 0.001)
    ratio = F.when(F.col("x_either") > 0, F.col("x_both") / F.col("x_either")).otherwise(0.0)
    within = near("both", F.col("x_both"), "both_error") & near("either", F.col("x_either"), "either_error") & near("jaccard", ratio, "jaccard_error")
    return both.select(F.col("x_left").alias("left_region"), F.col("x_right").alias("right_region"), "x_both", "x_either", within.alias("within"))


QUERIES = {
    "p3_distinct": p3_distinct,
    "p3_joint_regions": p3_joint_regions,
    "p3_joint_days": p3_joint_days,
    "p3_distinct_checked": p3_distinct_checked,
    "p3_joint_regions_checked": p3_joint_regions_checked,
}

_BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
_HELD = f"WITH s AS (SELECT order_date, region, lower(trim(customer_email, {_BLANKS})) AS e FROM sales), held AS (SELECT DISTINCT region, e FROM s WHERE e IS NOT NULL) "
ORACLE = {
    "p3_distinct_checked": _HELD
    + " UNION ALL ".join(
        f"SELECT '{level}' AS level, count(*) AS groups, sum(n)::BIGINT AS exact_total, true AS within FROM (SELECT count(DISTINCT e) AS n FROM s {by})"
        for level, by in (("date_region", "GROUP BY order_date, region"), ("date", "GROUP BY order_date"), ("region", "GROUP BY region"), ("all", ""))
    ),
    "p3_joint_regions_checked": _HELD
    + """SELECT k.region AS left_region, '*' AS right_region, (SELECT count(*) FROM held h WHERE h.region IS NOT DISTINCT FROM k.region AND EXISTS
            (SELECT 1 FROM held o WHERE o.e = h.e AND o.region IS DISTINCT FROM h.region)) AS x_both, (SELECT count(DISTINCT e) FROM held) AS x_either, true AS within
        FROM (SELECT DISTINCT region FROM s) k UNION ALL """
    + " UNION ALL ".join(
        f"SELECT '{a}', '{b}', (SELECT count(*) FROM (SELECT e FROM held WHERE region = '{a}' INTERSECT SELECT e FROM held WHERE region = '{b}')), "
        f"(SELECT count(DISTINCT e) FROM held WHERE region IN ('{a}', '{b}')), true"
        for a, b in REGION_PAIRS
    ),
}
