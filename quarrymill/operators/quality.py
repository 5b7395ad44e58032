"""Column-level data quality per load, with a classifier two-sample test against the first load of the source.

One scan counts rows by load and category (nulls, values outside the schema, region and paid); another counts the values
of amount per load with their categories. Both combine on the map side, so a load that holds a third of the rows sends
no more than its distinct combinations. A logistic regression per load (operators/shift_test.py), trained where the cells
of the load and of its first load meet, yields cross-fitted discrimination and its loss when a column is left out. Its amounts lie in quantiles
of both loads together, each at most a 32nd of them unless a single narrow bin holds more.

Changes of a distribution come from this test: an exact comparison, all in integers, follows for every load and column that the classifier
tells apart, and for every one it leaves open. A column is left open if some distribution with the counted cells would exceed the limit:
inside a cell the worst is assumed (for amount that all values of one load lie below those of the other, for region that they share none). So
whatever exceeds a limit is open, and the test can save comparisons but never lose a finding. Null rates, limits and distinct values are base aggregates.

The largest gap between two cumulative distributions is bounded from counts over logarithmic bins; only bins in which the
gap may pass the limit are looked at value by value.

Defined results: a load without rows gives nothing, nor does one whose first load has no rows (only ``out_of_limits`` then);
a load id missing from the loads table is compared with nothing; shares over no values compare with nothing; the null share is over
all rows; repeated rows count each; an empty table gives no rows; the input may have any other columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators import shift_test
from quarrymill.session import cut, write_once

REGIONS = ("EU", "US", "APAC")
COLUMNS = ("amount", "region", "paid")
NO_AMOUNT = -(1 << 30)
OTHER_REGIONS = 12
NULL_GAP, LIMIT_SHARE, KS_GAP, TV_GAP = (1, 10), (1, 50), (1, 5), (3, 20)
#: The classifier's amounts lie in so many quantiles of both loads, made of bins of which so many go to an octave.
QUANTILES, PER_OCTAVE = 32, 16
#: A column counts as told apart if its cross-fitted discrimination may exceed this (chance is 0.5), given three standard errors.
AUC_LEAST = 0.51
_INT = "decimal(38,0)"


def log_bin(x: Column, per_octave: int) -> Column:
    """A bin number that never falls as x rises."""
    d = x.cast("double")
    size = (F.floor(F.log2(F.abs(d)) * per_octave) + 1100 * per_octave).cast("int")
    return F.when(d > 0, size).when(d < 0, -size).otherwise(F.when(d == 0, 0))


def _region_class(c: Column) -> Column:
    out = F.when(c.isNull(), 0)
    for k, r in enumerate(REGIONS, 1):
        out = out.when(c == r, k)
    return out.otherwise(F.pmod(F.xxhash64(c), F.lit(OTHER_REGIONS)).cast("int") + len(REGIONS) + 1)


class LoadQuality:
    """Base aggregates, tests and findings of one sales table."""

    def __init__(self, sales: DataFrame, loads: DataFrame):
        w = Window.partitionBy("source")
        self.pairs = cut(
            loads.where("load_id IS NOT NULL")
            .groupBy("load_id")
            .agg(F.min("source").alias("source"))
            .select("load_id", F.when(F.col("source").isNotNull(), F.min("load_id").over(w)).alias("first_load"))
        )
        self.against = self.pairs.where("first_load IS NOT NULL AND load_id <> first_load")
        self.sales = sales.select("load_id", "sale_row", "amount", "region", "paid").where("load_id IS NOT NULL")
        amount = F.col("amount")
        self.base = cut(
            self.sales.groupBy("load_id", "region", "paid").agg(
                F.count("*").alias("n"),
                F.count_if(amount.isNull()).alias("no_amount"),
                F.count_if(amount < 0).alias("below"),
            )
        )
        self.values = write_once(self._values(), "amounts")

    def _values(self) -> DataFrame:
        """(load_id, amount, n, parts): the values of amount, with their counts by category and fold."""
        category = (
            _region_class(F.col("region")) * 8
            + F.when(F.col("paid").isNull(), 0).when(F.col("paid"), 1).otherwise(2) * 2
            + F.pmod(F.xxhash64("sale_row"), F.lit(2)).cast("int")
        )
        return (
            self.sales.select("load_id", "amount", category.cast("smallint").alias("category"))
            .groupBy("load_id", "amount", "category")
            .agg(F.count("*").alias("n"))
            .groupBy("load_id", "amount")
            .agg(F.sum("n").alias("n"), F.collect_list(F.struct("category", "n")).alias("parts"))
        )

    def totals(self) -> DataFrame:
        """Per load: rows, nulls per column and values outside the schema."""
        plain = self.base.groupBy("load_id").agg(
            F.sum("n").alias("n"),
            F.sum("no_amount").alias("no_amount"),
            F.sum("below").alias("below"),
            F.sum(F.when(F.col("region").isNull(), F.col("n")).otherwise(0)).alias("no_region"),
            F.sum(F.when(~F.col("region").isin(*REGIONS), F.col("n")).otherwise(0)).alias("odd_region"),
            F.sum(F.when(F.col("paid").isNull(), F.col("n")).otherwise(0)).alias("no_paid"),
        )
        distinct = self.values.where("amount IS NOT NULL").groupBy("load_id").agg(F.count("*").alias("amounts"))
        return plain.join(distinct, "load_id", "left").na.fill(0, ["amounts"])

    def tests(self) -> DataFrame:
        """The two-sample test of every load that has a first load other than itself."""
        part = F.explode("parts")
        cells = (
            self.values.select(
                "load_id",
                F.coalesce(log_bin(F.col("amount"), PER_OCTAVE), F.lit(NO_AMOUNT)).alias("bin"),
                part.alias("part"),
            )
            .groupBy("load_id", "bin", F.col("part.category").alias("category"))
            .agg(F.sum("part.n").alias("n"))
        )
        cells = cells.withColumn("cell", F.struct("bin", F.col("category").cast("int").alias("category"), "n"))
        cells = cut(cells.groupBy("load_id").agg(F.collect_list("cell").alias("cells")))  # bounded by the categories
        own = cells.join(self.against, "load_id")
        first = cells.select(F.col("load_id").alias("first_load"), F.col("cells").alias("first_cells"))
        schema = "load_id bigint, first_load bigint, auc_error double, auc_all double, " + ", ".join(
            f"auc_without_{c} double, auc_only_{c} double" for c in COLUMNS
        )
        schema += "".join(f", open_{c} boolean" for c in COLUMNS)
        paired = own.join(first, "first_load").select("load_id", "first_load", "cells", "first_cells")
        return paired.repartition(F.col("load_id")).mapInArrow(_test_batches, schema)

    @staticmethod
    def figures(tests: DataFrame) -> DataFrame:
        """(load_id, column_name, auc, auc_error, told_apart, open): what the classifier says of each column of a load, and leaves open."""
        c = lambda name: F.struct(
            F.lit(name).alias("column_name"),
            F.greatest(F.col(f"auc_only_{name}"), F.lit(0.5) + F.col("auc_all") - F.col(f"auc_without_{name}")).alias("auc"),
            F.col(f"open_{name}").alias("open"),
        )
        return (
            tests.select("load_id", "auc_error", F.explode(F.array(c("amount"), c("region"), c("paid"))).alias("c"))
            .select("load_id", "c.column_name", "c.auc", "auc_error", "c.open")
            .withColumn("told_apart", F.col("auc") + 3 * F.col("auc_error") > AUC_LEAST)
        )

    @staticmethod
    def _beside_first(counts: DataFrame, value: str, pairs: DataFrame) -> DataFrame:
        """(load_id, value, a, b): counts of a load and of its first load. counts: load_id, value, n; pairs: load_id, first_load."""
        mine = counts.join(pairs.select("load_id"), "load_id").select("load_id", value, F.col("n").alias("a"), F.lit(0).alias("b"))
        ref = counts.withColumnRenamed("load_id", "first_load").join(pairs, "first_load")
        both = mine.unionByName(ref.select("load_id", value, F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")))
        return both.groupBy("load_id", value).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def _share_change(self, column: str, pairs: DataFrame) -> DataFrame:
        """Loads in which half the sum of the absolute differences of shares exceeds the limit."""
        counts = self.base.where(F.col(column).isNotNull()).groupBy("load_id", column).agg(F.sum("n").alias("n"))
        both = self._beside_first(counts, column, pairs)
        size = both.groupBy("load_id").agg(F.sum("a").cast(_INT).alias("an"), F.sum("b").cast(_INT).alias("bn"))
        gap = F.sum(F.abs(F.col("a").cast("decimal(18,0)") * F.col("bn").cast("decimal(18,0)") - F.col("b").cast("decimal(18,0)") * F.col("an").cast("decimal(18,0)")))
        up, down = TV_GAP
        return (
            both.join(size, "load_id")
            .groupBy("load_id", "an", "bn")
            .agg(gap.cast(_INT).alias("gap"))
            .where((F.col("an") > 0) & (F.col("bn") > 0))
            .where(F.col("gap") * down > _product(F.col("an"), F.col("bn")) * (2 * up))
            .select("load_id")
        )

    def _cumulative_change(self, pairs: DataFrame | None = None) -> DataFrame:
        """Loads (of the pairs given, else all) whose amounts' cumulative distribution departs from that of the first load by more than the limit."""
        up, down = KS_GAP
        pairs = self.against if pairs is None else pairs
        binned = self.values.where("amount IS NOT NULL").withColumn("bin", log_bin(F.col("amount"), 64))
        both = self._beside_first(binned.groupBy("load_id", "bin").agg(F.sum("n").alias("n")), "bin", pairs)
        whole = Window.partitionBy("load_id")
        along = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = (
            both.withColumns({"an": F.sum("a").over(whole), "bn": F.sum("b").over(whole)})
            .withColumns({"ca": F.sum("a").over(along), "cb": F.sum("b").over(along)})
            .where("an > 0 AND bn > 0")
        )
        gap = lambda a, b: _product(a, F.col("bn")) - _product(b, F.col("an"))
        limit = lambda x: F.abs(x) * down > _product(F.col("an"), F.col("bn")) * up
        run = cut(
            run.withColumn("sure", limit(gap(F.col("ca"), F.col("cb")))).withColumn(
                "open",
                limit(gap(F.col("ca"), F.col("cb") - F.col("b"))) | limit(gap(F.col("ca") - F.col("a"), F.col("cb"))),
            )
        )
        sure = run.where("sure").select("load_id").distinct()
        rest = run.where("open").join(sure, "load_id", "left_anti")
        rest = rest.select("load_id", "bin", "an", "bn", (F.col("ca") - F.col("a")).alias("a0"), (F.col("cb") - F.col("b")).alias("b0"))
        inside = binned.select("load_id", "bin", "amount", "n")
        mine = rest.join(inside, ["load_id", "bin"]).select(*rest.columns, "amount", F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b"))
        ref = rest.join(pairs, "load_id").join(
            inside.withColumnRenamed("load_id", "first_load"), ["first_load", "bin"]
        ).select(*rest.columns, "amount", F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))
        step = Window.partitionBy("load_id", "bin").orderBy("amount").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        found = (
            mine.unionByName(ref)
            .withColumns({"ca": F.col("a0") + F.sum("a").over(step), "cb": F.col("b0") + F.sum("b").over(step)})
            .where(limit(gap(F.col("ca"), F.col("cb"))))
            .select("load_id")
        )
        return sure.union(found).distinct()

    def findings(self) -> DataFrame:
        """(load_id, column_name, finding)."""
        return cut(self.report()).select("load_id", "column_name", "finding")

    def report(self) -> DataFrame:
        """(load_id, column_name, finding, auc, auc_error, open, told_apart): the findings, each with the classifier's figures (null for
        a load that has no first load other than itself)."""
        totals = cut(self.totals())
        figures = cut(self.figures(self.tests()))
        first = totals.select(F.col("load_id").alias("first_load"), *(F.col(c).alias(f"f_{c}") for c in totals.columns[1:]))
        beside = totals.join(self.against, "load_id").join(first, "first_load")
        parts = []
        candidates = figures.where("told_apart OR open")

        def compared(column: str) -> DataFrame:
            """The pairs of loads whose column the test tells apart or leaves open."""
            return self.against.join(F.broadcast(candidates.where(F.col("column_name") == column).select("load_id")), "load_id")

        def finding(rows: DataFrame, column: str, name: str) -> DataFrame:
            return rows.select("load_id", F.lit(column).alias("column_name"), F.lit(name).alias("finding"))

        up, down = NULL_GAP
        for c in ("amount", "region", "paid"):
            gap = F.abs(_product(F.col(f"no_{c}"), F.col("f_n")) - _product(F.col(f"f_no_{c}"), F.col("n")))
            parts.append(finding(beside.where(gap * down > _product(F.col("n"), F.col("f_n")) * up), c, "null_rate"))
        values = F.col("n") - F.col("no_amount")
        first_values = F.col("f_n") - F.col("f_no_amount")
        rarer = _product(F.col("amounts"), first_values) * 2 < _product(F.col("f_amounts"), values)
        parts.append(finding(beside.where((values > 0) & (first_values > 0) & rarer), "amount", "distinct"))
        for c in ("region", "paid"):
            parts.append(finding(self._share_change(c, compared(c)), c, "distribution"))
        parts.append(finding(self._cumulative_change(compared("amount")), "amount", "distribution"))
        up, down = LIMIT_SHARE
        parts += [
            finding(totals.where(F.col(bad) * down > (F.col("n") - F.col(none)) * up), c, "out_of_limits")
            for c, bad, none in (("amount", "below", "no_amount"), ("region", "odd_region", "no_region"))
        ]
        return reduce(DataFrame.unionByName, parts).join(figures, ["load_id", "column_name"], "left")


def _product(a: Column, b: Column) -> Column:
    return (a.cast("decimal(18,0)") * b.cast("decimal(18,0)")).cast(_INT)


def _test_batches(batches: Iterable) -> Iterator:
    import pyarrow as pa

    names = ["error", "all", *(f"{k}_{c}" for c in COLUMNS for k in ("without", "only"))]
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            found, doubt = _test_one(*(one.column(c).flatten() for c in (2, 3)))
            yield pa.record_batch(
                [one.column(0), one.column(1), *(pa.array([found[k]], pa.float64()) for k in names), *(pa.array([doubt[c]], pa.bool_()) for c in COLUMNS)],
                names=["load_id", "first_load", *(f"auc_{k}" for k in names), *(f"open_{c}" for c in COLUMNS)],
            )


def _test_one(mine, first) -> tuple[dict, dict]:
    """The classifier's figures for a load and its first load, and per column whether the counted cells leave a change above the limit open."""
    get = lambda c: np.concatenate([first.field(c).to_numpy(), mine.field(c).to_numpy()]).astype(np.int64)
    bins, category, n = (get(c) for c in ("bin", "category", "n"))
    second = np.arange(len(n)) >= len(first)
    fold, paid, region = category % 2, category // 2 % 4, category // 8
    n0, n1 = np.where(second, 0, n).astype(float), np.where(second, n, 0).astype(float)
    found = shift_test.discriminate({"amount": [quantile_groups(bins, n0, n1)], "region": [region], "paid": [paid]}, fold, n0, n1)
    return found, {
        "amount": widest_gap(bins, n0, n1) > KS_GAP[0] / KS_GAP[1] - 1e-9,
        "region": widest_distance(region, n0, n1, split=region > len(REGIONS)) > TV_GAP[0] / TV_GAP[1] - 1e-9,
        "paid": widest_distance(paid, n0, n1) > TV_GAP[0] / TV_GAP[1] - 1e-9,
    }


def _shares(at: np.ndarray, n0: np.ndarray, n1: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.bincount(at, n1, size), np.bincount(at, n0, size)
    return a / max(a.sum(), 1.0), b / max(b.sum(), 1.0)


def quantile_groups(bins: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """A number per cell: the quantile of both samples (of equal weight) in which its bin lies; bins are not divided."""
    values, at = np.unique(bins, return_inverse=True)
    a, b = _shares(at, n0, n1, len(values))
    weight = (a + b) / 2
    group = np.floor((np.cumsum(weight) - weight / 2) * QUANTILES).astype(np.int64)
    group[values == NO_AMOUNT] = -1
    return np.unique(group, return_inverse=True)[1][at]


def widest_gap(bins: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """The largest gap between two cumulative distributions that have these counts in rising bins, however the values lie within them."""
    held = bins != NO_AMOUNT
    values, at = np.unique(bins[held], return_inverse=True)
    if not len(values) or not n0[held].sum() or not n1[held].sum():
        return 0.0
    a, b = _shares(at, n0[held], n1[held], len(values))
    ca, cb = np.cumsum(a), np.cumsum(b)
    return float(max(np.abs(ca - (cb - b)).max(), np.abs((ca - a) - cb).max()))


def widest_distance(classes: np.ndarray, n0: np.ndarray, n1: np.ndarray, split: np.ndarray | None = None) -> float:
    """Half the sum of the differences of shares of the values (class 0: null, left out); a class that is ``split`` holds several values, of which the samples may share none."""
    held = classes > 0
    if not n0[held].sum() or not n1[held].sum():
        return 0.0
    size = int(classes.max()) + 1
    a, b = _shares(classes[held], n0[held], n1[held], size)
    several = np.zeros(size, bool) if split is None else np.bincount(classes[held], split[held], size) > 0
    return float(np.where(several, a + b, np.abs(a - b)).sum() / 2)


#: The schema's columns with the test of a single value (of those that the type does not hold already).
EMAIL = r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}"


def profile(sales: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per load and column: rows, nulls, distinct values, range (as text), values outside the schema.

    Values are counted once per load, column and value; distinct counts and nulls are read from these counts.
    """
    outside = {
        "order_id": lambda c: c < 1,
        "customer_email": lambda c: ~c.rlike(rf"\A(?:{EMAIL})\z"),
        "region": lambda c: ~c.isin(*REGIONS),
        "amount": lambda c: c < 0,
    }
    long = sales.where("load_id IS NOT NULL").select(
        "load_id",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).cast("string").alias("value"),
                        (F.col(c).cast("decimal(38,2)") if c in ("order_id", "amount") else F.lit(None)).cast("decimal(38,2)").alias("number"),
                        F.coalesce(outside[c](F.col(c)) if c in outside else F.lit(False), F.lit(False)).alias("outside"),
                    )
                    for c in columns
                )
            )
        ).alias("x"),
    )
    counted = long.groupBy("load_id", "x.column_name", "x.value", "x.number", "x.outside").agg(F.count("*").alias("n"))
    numeric = F.col("column_name").isin("order_id", "amount")
    return counted.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.min(F.when(numeric, F.col("number"))).cast("string"), F.min("value")).alias("lowest"),
        F.coalesce(F.max(F.when(numeric, F.col("number"))).cast("string"), F.max("value")).alias("highest"),
        F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)).alias("outside_schema"),
    )
