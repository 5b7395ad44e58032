"""Row validation: coercion, rules, duplicate groups and the split into valid and quarantined rows.

The input is a raw frame: ``_row`` (dense record number), ``_problem`` (why a record could not be split, else null) and
one text column per source name. One lineage adds per row an array of issues; nothing is collected.

Duplicate groups are found by a partial aggregation over each unique column (so a value that a third of the rows share is one row
per task), joined back only for values with two or more rows: a hot value is salted on both sides.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import coerce
from quarrymill.model import ROW, Column, Policy, Schema

PROBLEM = "_problem"
MASKED = "<masked>"
SHOWN = 40
ISSUE = "struct<column:string,rule:string,message:string,value:string>"
SALTS = 16
#: Patterns of literals, plain classes without shorthands, groups and repeats mean the same in Java and Python.
_SAFE_PATTERN = re.compile(r"(?:[\w@:;,=<>!#%&~'\"/ -]|\\[.\-+*?(){}|/@]|\.|\[\^?[\w@.:,+% -]+\]|[*+?](?![+])|\{[0-9]+(?:,[0-9]*)?\}|\((?!\?)|\(\?:|\)|\|)*\Z", re.ASCII)


def quoted(name: str) -> C:
    return F.col("`" + name.replace("`", "``") + "`")


def matches(text: C, pattern: str) -> C:
    """Whether the whole text matches a Python pattern; natively where both dialects agree, else vectorised in Python."""
    if _SAFE_PATTERN.match(pattern) and "." not in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        return text.rlike(rf"\A(?:{pattern})\z")
    compiled = re.compile(pattern)

    @F.pandas_udf("boolean")
    def full(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else compiled.fullmatch(x) is not None)

    return full(text)


def shown(text: C, col: Column, policy: Policy) -> C:
    """What an issue shows of a value: nothing personal where the policy masks, else at most 40 characters."""
    if col.pii and policy.mask_pii:
        return F.when(text.isNotNull(), MASKED)
    return F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN - 3), F.lit("..."))).otherwise(text)


def _issue(when: C, col: Column, rule: str, message: C | str, text: C, policy: Policy) -> C:
    message = F.lit(message) if isinstance(message, str) else message
    return _when(when, F.struct(F.lit(col.name).alias("column"), F.lit(rule).alias("rule"), message.alias("message"), shown(text, col, policy).alias("value")))


def _when(holds: C, issue: C) -> C:
    """An array of the issue or of none: arrays are joined by compiled code, which filtering with a lambda is not."""
    return F.when(holds, F.array(issue.cast(ISSUE))).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _show_bound(v) -> str:
    return format(v, "f") if hasattr(v, "as_tuple") else v.isoformat() if hasattr(v, "isoformat") else str(v)


def _rules(col: Column, value: C, text: C, policy: Policy) -> list[C]:
    out = []
    lit = lambda v: F.lit(v).cast(col.spark_type)
    if col.min is not None:
        out.append(_issue(value < lit(col.min), col, "min", f"below minimum {_show_bound(col.min)}", text, policy))
    if col.max is not None:
        out.append(_issue(value > lit(col.max), col, "max", f"above maximum {_show_bound(col.max)}", text, policy))
    if col.allowed:
        out.append(_issue(~value.isin(*[lit(v) for v in col.allowed]), col, "allowed", "value is not in the allowed list", text, policy))
    if col.type == "string":
        if col.max_length is not None:
            out.append(_issue(F.length(value) > col.max_length, col, "max_length", f"longer than {col.max_length} characters", text, policy))
        if col.pattern:
            out.append(_issue(~matches(value, col.pattern), col, "pattern", "does not match the required pattern", text, policy))
    return out


def typed(raw: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """``_row``, ``_problem``, a typed column per schema column, ``_text`` (struct of the cells' texts), ``_issues``."""
    present = set(raw.columns)
    texts, parsed = [], []
    for c in schema.columns:
        if c.src in present:
            text = quoted(c.src).cast("string")
            text = F.when(~text.isin(*schema.null_tokens), text) if schema.null_tokens else text
        else:
            text = F.lit(None).cast("string")
        texts.append(text.alias(c.name))
    kept = [x for x in raw.columns if x not in {ROW, PROBLEM}]
    step = raw.select(ROW, PROBLEM, F.struct(*(quoted(x) for x in kept)).alias("_raw") if kept else F.lit(None).alias("_raw"), F.struct(*texts).alias("_text"))
    # a column each, not a struct of all: the optimizer would repeat a struct's members at every use
    for k, c in enumerate(schema.columns):
        text = quoted("_text")[c.name]
        parsed.append(F.when(F.col(PROBLEM).isNull(), coerce.value(text, c)).alias(f"_parsed_{k}"))
    step = step.select(ROW, PROBLEM, "_raw", "_text", *parsed)
    issues = [
        _when(
            F.col(PROBLEM).isNotNull(),
            F.struct(F.lit("").alias("column"), F.lit("structure").alias("rule"), F.col(PROBLEM).alias("message"), F.lit(None).cast("string").alias("value")),
        )
    ]
    whole = F.col(PROBLEM).isNull()
    for k, c in enumerate(schema.columns):
        text, got = F.col("_text")[c.name], F.col(f"_parsed_{k}")
        if c.required and c.src in present:
            issues.append(_issue(whole & text.isNull(), c, "required", "required value is missing", text, policy))
        if c.type != "string":
            issues.append(_issue(whole & text.isNotNull() & got.isNull(), c, "type", coerce.error(text, got, c), text, policy))
        issues += _rules(c, got, text, policy)
    return step.select(
        ROW,
        PROBLEM,
        "_raw",
        "_text",
        *(F.col(f"_parsed_{k}").alias(c.name) for k, c in enumerate(schema.columns)),
        F.concat(*issues).alias("_issues"),
    )


def duplicate_groups(rows: DataFrame, keys: list[str], row: str = ROW) -> DataFrame:
    """(keys..., members, first_row) of values that two or more rows share; null keys are left out."""
    whole = rows.dropna(subset=keys)
    part = whole.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    return part.groupBy(*keys).agg(F.sum("n").alias("members"), F.min("first").alias("first_row")).where("members > 1")


def with_duplicates(rows: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """Adds an issue to every member of each duplicate group, in schema order after the row's own issues.

    Every unique column's groups are counted from the rows as they came in, so the input is read once more per
    unique column, never once per combination.
    """
    base, columns = rows, rows.columns
    for c in (c for c in schema.columns if c.unique):
        masked = c.pii and policy.mask_pii
        # personal values are hashed before they are shuffled, and their texts stay where they are
        key = F.sha2(F.col(c.name).cast("string"), 256) if masked else F.col(c.name)
        text = F.lit(MASKED) if masked else F.col("_text")[c.name]
        keyed = base.select(F.col(ROW).alias("_r"), key.alias("_key"), text.alias("_t")).where("_key IS NOT NULL")
        part = keyed.groupBy("_key", F.spark_partition_id().alias("_part")).agg(F.count("*").alias("n"), F.min(F.struct("_r", "_t")).alias("first"))
        groups = part.groupBy("_key").agg(F.sum("n").alias("_members"), F.min("first").alias("_first")).where("_members > 1")
        groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        issue = _issue(
            F.lit(True),
            c,
            "unique",
            F.concat(F.lit("value occurs in "), F.col("_members").cast("string"), F.lit(" rows")),
            F.col("_first")["_t"],
            policy,
        )
        rows = (
            rows.withColumns({"_key": key, "_salt": F.pmod(F.col(ROW), F.lit(SALTS)).cast("int")})
            .join(groups, ["_key", "_salt"], "left")
            .withColumn("_issues", F.when(F.col("_members").isNull(), F.col("_issues")).otherwise(F.concat(F.col("_issues"), issue)))
            .select(*columns)
        )
    return rows


def validate(raw: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """Every row with its typed values and all its issues."""
    return with_duplicates(typed(raw, schema, policy), schema, policy)


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("_issues") == 0)


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("_issues") > 0)


def issues(checked: DataFrame) -> DataFrame:
    """One row per issue: _row, position, column, rule, message, value."""
    return checked.select(ROW, F.posexplode_outer("_issues").alias("position", "issue")).where("position IS NOT NULL").select(ROW, "position", "issue.*")


def counts_by_rule(checked: DataFrame) -> DataFrame:
    """Issues per rule: rows are counted by their set of rules first, of which there are few, and only these are taken apart."""
    kinds = checked.select(F.col("_issues")["rule"].alias("rules")).groupBy("rules").agg(F.count("*").alias("n"))
    # outer: else the optimizer infers a filter on the array and evaluates all rules a second time at the scan
    return kinds.select(F.explode_outer("rules").alias("rule"), "n").where("rule IS NOT NULL").groupBy("rule").agg(F.sum("n").alias("n"))


def summary(checked: DataFrame) -> DataFrame:
    """One row: all, valid and quarantined rows and the error rate."""
    bad = F.count_if(F.size("_issues") > 0)
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("_issues") == 0).alias("valid"),
        bad.alias("quarantined"),
        F.when(F.count("*") > 0, F.try_divide(bad.cast("double"), F.count("*"))).alias("error_rate"),
    )


def engine_table(checked: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """The table that metrics see: ``_row`` and the schema's columns, without personal ones where the policy masks."""
    return valid(checked).select(ROW, *(c.name for c in schema.columns if not (c.pii and policy.mask_pii)))
