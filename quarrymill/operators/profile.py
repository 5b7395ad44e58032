"""Built-in column statistics by two independent paths that must agree.

Path one is a single aggregate by Catalyst. Path two adds rows one at a time in Python workers with
exact decimals and merges the partial results; distinct values are compared by counts per value hash, aggregated apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Context, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.model import Column, Policy, Schema

_CONTEXT = Context(prec=120)
NUMERIC, RANGED = ("integer", "decimal"), ("integer", "decimal", "date")


def hidden(col: Column, policy: Policy) -> bool:
    return col.pii and policy.mask_pii


def sql_profile(data: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """(column, rows, nulls, distinct, lowest, highest, total), texts for values.

    Counts, ranges and sums come from one aggregate for all columns, and distinct counts from a second one over pairs of column and value,
    combined on the map side, so that the first one needs no copy of a row per column.
    """
    parts, none = [], F.lit(None).cast("string")
    for c in schema.columns:
        v = F.col(c.name)
        ranged, numeric = c.type in RANGED and not hidden(c, policy), c.type in NUMERIC and not hidden(c, policy)
        total = F.sum(v.cast("decimal(38,0)")) if c.type == "integer" else F.sum(v) if numeric else None
        parts.append(
            F.struct(
                F.lit(c.name).alias("column"),
                F.count("*").alias("rows"),
                (F.count("*") - F.count(v)).alias("nulls"),
                (F.min(v).cast("string") if ranged else none).alias("lowest"),
                (F.max(v).cast("string") if ranged else none).alias("highest"),
                (total.cast("string") if numeric else none).alias("total"),
            )
        )
    plain = data.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c.name).cast("string").alias("v")) for k, c in enumerate(schema.columns)))
    counted = data.select(F.explode(values).alias("x")).where("x.v IS NOT NULL").groupBy("x.k", "x.v").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("distinct"))
    named = F.element_at(F.array(*(F.lit(c.name) for c in schema.columns)), F.col("k") + 1)
    both = plain.join(F.broadcast(counted.select(named.alias("column"), "distinct")), "column", "left")  # a row per column
    return both.select("column", "rows", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "lowest", "highest", "total")


def _add(batches: Iterable, kinds: list[tuple[str, str, bool]]) -> Iterator:
    import pyarrow as pa

    state = [[0, 0, None, None, Decimal(0)] for _ in kinds]
    for batch in batches:
        for k, (_, kind, hide) in enumerate(kinds):
            s = state[k]
            for v in batch.column(k).to_pylist():
                s[0] += 1
                if v is None:
                    s[1] += 1
                elif kind in RANGED and not hide:
                    s[2] = v if s[2] is None or v < s[2] else s[2]
                    s[3] = v if s[3] is None or v > s[3] else s[3]
                    if kind in NUMERIC:
                        s[4] = _CONTEXT.add(s[4], Decimal(v))
    show = lambda v: None if v is None else format(v, "f") if isinstance(v, Decimal) else str(v)
    yield pa.record_batch(
        [
            pa.array([n for n, _, _ in kinds]),
            pa.array([s[0] for s in state], pa.int64()),
            pa.array([s[1] for s in state], pa.int64()),
            *(pa.array([show(s[j]) for s in state], pa.string()) for j in (2, 3, 4)),
        ],
        names=["column", "rows", "nulls", "lowest", "highest", "total"],
    )


def python_profile(data: DataFrame, schema: Schema, policy: Policy) -> dict[str, dict]:
    """The same statistics from partial results of every partition, merged on the driver (a row per partition and column)."""
    kinds = [(c.name, c.type, hidden(c, policy)) for c in schema.columns]
    picked = data.select(*(F.col(n).cast("string") if h else F.col(n) for n, _, h in kinds))
    parts = picked.mapInArrow(lambda b: _add(b, kinds), "column string, rows bigint, nulls bigint, lowest string, highest string, total string")
    out: dict[str, dict] = {}
    by_name = {c.name: c for c in schema.columns}
    for r in parts.collect():
        c = by_name[r["column"]]
        key = (lambda t: Decimal(t)) if c.type in NUMERIC else (lambda t: t)
        o = out.setdefault(c.name, {"rows": 0, "nulls": 0, "lowest": None, "highest": None, "total": Decimal(0)})
        o["rows"] += r["rows"]
        o["nulls"] += r["nulls"]
        if r["lowest"] is not None:
            o["lowest"] = r["lowest"] if o["lowest"] is None else min(o["lowest"], r["lowest"], key=key)
            o["highest"] = r["highest"] if o["highest"] is None else max(o["highest"], r["highest"], key=key)
        o["total"] = _CONTEXT.add(o["total"], Decimal(r["total"]))
    for c in schema.columns:
        o = out.setdefault(c.name, {"rows": 0, "nulls": 0, "lowest": None, "highest": None, "total": Decimal(0)})
        shown = c.type in NUMERIC and not hidden(c, policy) and o["rows"] > o["nulls"]
        o["total"] = format(o["total"], "f") if shown else None
    return out


def distinct_counts(data: DataFrame, schema: Schema) -> dict[str, int]:
    """Exact distinct counts by a second way: one shuffle of value hashes of all columns."""
    long = data.select(
        F.explode(F.array(*(F.struct(F.lit(c.name).alias("column"), F.sha2(F.col(c.name).cast("string"), 256).alias("h")) for c in schema.columns))).alias("x")
    ).where("x.h IS NOT NULL")
    return {r["column"]: r["n"] for r in long.groupBy("x.column", "x.h").count().groupBy("column").agg(F.count("*").alias("n")).collect()}


def reconcile(data: DataFrame, schema: Schema, policy: Policy) -> tuple[list[dict], list[str]]:
    """(profile by Catalyst, mismatches with the independent path)."""
    first = [r.asDict() for r in sql_profile(data, schema, policy).collect()]
    second, distinct = python_profile(data, schema, policy), distinct_counts(data, schema)
    wrong = []
    for p in first:
        own = second[p["column"]] | {"distinct": distinct.get(p["column"], 0)}
        for k in ("rows", "nulls", "distinct", "lowest", "highest", "total"):
            a, b = p[k], own[k]
            numeric = k in ("lowest", "highest", "total") and schema.column(p["column"]).type in NUMERIC
            if (a is None) != (b is None) or a is not None and (Decimal(a) != Decimal(b) if numeric else a != b):
                wrong.append(f"{p['column']}.{k}")
    return first, wrong
