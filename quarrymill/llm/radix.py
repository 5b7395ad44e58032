"""Percentiles of very large numeric columns by radix selection.

A number maps to a 64-bit integer of the same order: sign, exponent and mantissa of its double. Each pass counts the
next digit per group (partial counts on the map side, at most 2^digit counts a group), finds the digit that holds each target
rank, and the next pass counts only values with those leading digits. After d passes of w bits a result lies in a known
interval whose relative width is at most 2^-(d*w - 12); after all 64 bits it is the value itself to double precision.

Counts of leading digits are also the mergeable summary: those of single loads or days add up to those of all, and
percentiles read from sums keep the same error bound.

A percentile p of n values is the value of rank max(1, ceil(p * n)) in ascending order.

The table is read once for the first digit and once for each later one, whatever the number of levels.

Defined results: null and NaN values are left out; a group of only such values gives no row; null group values form a group;
-0 equals 0; infinities are ordinary ends of the order; ties count each; an empty table gives an empty result;
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import cut

DIGIT_BITS = 16
#: Targets of up to this many rows (about 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_TARGETS = 200_000


_LOWEST = 2.0**-1022


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _scaled(size: Column, e: Column) -> Column:
    """size / 2^e, in two steps, as the power itself may be too small for a double."""
    half = F.floor(e / 2).cast("double")
    return size * _power(-half) * _power(half - e)


def with_key(df: DataFrame, number: str, key: str) -> DataFrame:
    """Adds an integer of the same order as a column of doubles: their bits, with the sign turned into that of the integer.

    The bits are computed by exact arithmetic in compiled code: the exponent from the logarithm, put right by comparison, and the mantissa by
    scaling with powers of two. Each step is a column of its own, so nothing is computed twice.
    """
    x, size = F.col(number), F.col("_size")
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("double")
    steps = (
        df.withColumn("_size", F.abs(x))
        .withColumn("_guess", guess)
        .withColumn("_near", _scaled(size, F.col("_guess")))
        .withColumn("_exponent", F.col("_guess") + F.when(F.col("_near") >= 2.0, 1.0).when(F.col("_near") < 1.0, -1.0).otherwise(0.0))
        .withColumn("_mantissa", _scaled(size, F.col("_exponent")) * F.lit(2.0**52))
    )
    normal = (F.col("_exponent") + 1022).cast("bigint") * F.lit(1 << 52) + F.col("_mantissa").cast("bigint")
    small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = F.when(size == 0, F.lit(0)).when(size < _LOWEST, small).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return steps.withColumn("_bits", bits).withColumn(key, F.when(x < 0, -F.col("_bits")).otherwise(F.col("_bits"))).drop("_size", "_guess", "_near", "_exponent", "_mantissa", "_bits")


def value_of(key: Column) -> Column:
    """The double behind a key; applied to results only."""
    size = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.abs(key)).cast("double")
    return F.when(key < 0, -size).otherwise(size)


def _numbers(df: DataFrame, groups: Sequence[str], value: Column) -> DataFrame:
    """groups..., key: rows with a number only, each key computed once a row."""
    rows = df.select(*(F.col(g) for g in groups), value.cast("double").alias("_number")).where(F.col("_number").isNotNull() & ~F.isnan("_number"))
    return with_key(rows, "_number", "key").select(*groups, "key")


def _same(a: list[str], left: DataFrame, right: DataFrame) -> Column:
    on = F.lit(True)
    for g in a:
        on = on & left[g].eqNullSafe(right[f"t_{g}"])
    return on


def summaries(df: DataFrame, groups: Sequence[str], value: Column, bits: int = 19) -> DataFrame:
    """(groups..., prefix, n): counts of the leading ``bits`` of the keys, relative error 2^-(bits-12) at most."""
    return (
        _numbers(df, groups, value)
        .select(*groups, F.shiftright("key", 64 - bits).alias("prefix"))
        .groupBy(*groups, "prefix")
        .agg(F.count("*").alias("n"))
    )


def merge(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    return parts.groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))


def _pick(counts: DataFrame, groups: list[str], before: Column) -> DataFrame:
    """The prefix that holds each target. counts: groups..., percentile, rank, before, prefix, n."""
    w = Window.partitionBy(*groups, "percentile").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = before + F.sum("n").over(w)
    return (
        counts.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .withColumn("before", F.col("upto") - F.col("n"))
        .drop("upto")
    )


def _targets(first: DataFrame, groups: list[str], percentiles: Sequence[float]) -> DataFrame:
    """Every group's target ranks with the prefix of the first pass that holds them. first: groups..., prefix, n."""
    whole = Window.partitionBy(*groups)
    upto = F.sum("n").over(whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        first.withColumn("total", F.sum("n").over(whole))
        .withColumn("upto", upto)
        .withColumn("percentile", F.explode(F.array(*(F.lit(float(p)) for p in percentiles))))
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("total"))).cast("bigint"))
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select(*groups, "percentile", "rank", "total", "prefix", "n", (F.col("upto") - F.col("n")).alias("before"))
    )


def from_summary(parts: DataFrame, groups: Sequence[str], percentiles: Sequence[float], bits: int = 19) -> DataFrame:
    """Percentiles of merged summaries: the interval that holds each, its middle and the relative error bound."""
    groups = list(groups)
    got = _targets(merge(parts, groups), groups, percentiles)
    shift = 64 - bits
    low_key = F.shiftleft(F.col("prefix"), shift)
    high_key = F.shiftleft(F.col("prefix"), shift) + F.lit(2**shift - 1).cast("bigint")
    return got.select(
        *groups,
        "percentile",
        "total",
        ((value_of(low_key) + value_of(high_key)) / 2).alias("value"),
        value_of(low_key).alias("low"),
        value_of(high_key).alias("high"),
        F.lit(2.0 ** -(bits - 12)).alias("relative_error"),
    )


def percentiles(
    df: DataFrame,
    levels: dict[str, list[str]],
    value: Column,
    wanted: Sequence[float],
    digit_bits: int = DIGIT_BITS,
    passes: int | None = None,
) -> DataFrame:
    """Exact percentiles (to double precision) per group of every level; fewer ``passes`` leave a stated interval.

    The finest level must hold the columns of all others: its counts of the first digit give those of the rest.
    """
    if 64 % digit_bits:
        raise ValueError("the digits must divide 64 bits")
    passes = passes or 64 // digit_bits
    every = max(levels.values(), key=len)
    rows = _numbers(df, every, value)
    first = cut(
        rows.withColumn("prefix", F.shiftright("key", 64 - digit_bits))
        .groupBy(*every, "prefix")
        .agg(F.count("*").alias("n"))
    )
    got = {level: cut(_targets(merge(first, groups), groups, wanted)) for level, groups in levels.items()}
    for k in range(1, passes):
        done, now = 64 - k * digit_bits, 64 - (k + 1) * digit_bits
        # one scan for all levels: a row is counted if it lies in a digit that some level looks into
        seen = rows
        for number, (level, groups) in enumerate(levels.items()):
            places = got[level].select(*(F.col(g).alias(f"t_{g}") for g in groups), F.col("prefix").alias("t_prefix")).distinct()
            places = places.withColumn(f"wanted_{number}", F.lit(True))
            if places.count() <= BROADCAST_TARGETS:
                places = F.broadcast(places)
            on = _same(groups, seen, places) & (F.shiftright(seen["key"], done) == places["t_prefix"])
            seen = seen.join(places, on, "left").drop("t_prefix", *(f"t_{g}" for g in groups))
        flags = [f"wanted_{number}" for number in range(len(levels))]
        counts = cut(
            seen.where(F.coalesce(*flags))
            .withColumn("prefix", F.shiftright("key", now))
            .groupBy(*every, "prefix", *flags)
            .agg(F.count("*").alias("n"))
        )
        for number, (level, groups) in enumerate(levels.items()):
            own = counts.where(flags[number]).groupBy(*groups, "prefix").agg(F.sum("n").alias("n"))
            own = own.withColumn("parent", F.shiftright("prefix", digit_bits))
            last = got[level].select(
                *(F.col(g).alias(f"t_{g}") for g in groups), "percentile", "rank", "total", "before", F.col("prefix").alias("t_prefix")
            )
            both = own.join(last, _same(groups, own, last) & (own["parent"] == last["t_prefix"]))
            both = both.select(*groups, "percentile", "rank", "total", "before", "prefix", "n")
            got[level] = cut(_pick(both, groups, F.col("before")))
    rest = 64 - passes * digit_bits
    out = None
    for level, groups in levels.items():
        low = F.shiftleft(F.col("prefix"), rest) if rest else F.col("prefix")
        high = low + F.lit(2**rest - 1).cast("bigint") if rest else low
        part = got[level].select(
            F.lit(level).alias("level"),
            *((F.col(g) if g in groups else F.lit(None).cast(rows.schema[g].dataType)).alias(g) for g in every),
            "percentile",
            F.col("total").alias("n_values"),
            value_of(low).alias("low"),
            value_of(high).alias("high"),
            F.lit(2.0 ** -(passes * digit_bits - 12)).alias("relative_error"),
        )
        out = part if out is None else out.unionByName(part)
    return out
