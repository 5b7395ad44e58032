"""Type inference and drift: one aggregate over all columns decides every type."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.coerce import date, decimal, integer
from quarrymill.model import ROW, Column, Schema
from quarrymill.operators.validate import PROBLEM, quoted

#: Parts of names that suggest personal data (fixed values): any of them anywhere in a name, whatever its case.
PERSONAL_WORDS = (
    "name", "email", "e-mail", "e_mail", "e mail", "phone", "mobile", "fax", "address", "street", "postcode", "birth", "dob", "passport", "ssn", "social security",
    "national id", "iban", "account no", "card", "salary", "wage", "income",
)
PII_HINT = re.compile("(?i)" + "|".join(map(re.escape, PERSONAL_WORDS)))
INFER_SCALE = 18


def clean_name(source: str, taken: set[str]) -> str:
    """An identifier made of a header: accents folded, other characters to underscores, repeated ones numbered."""
    text = unicodedata.normalize("NFKD", source).encode("ascii", "ignore").decode().lower()
    text = re.sub(r"[^a-z0-9]+", "_", text).strip("_") or "column"
    base = f"_{text}" if text[0].isdigit() else text
    name, k = base, 2
    while name in taken or name == ROW:
        name, k = f"{base}_{k}", k + 1
    return name


def column_facts(raw: DataFrame) -> DataFrame:
    """One row per source column: rows, missing, and whether all values parse as each type."""
    sources = [c for c in raw.columns if c not in (ROW, PROBLEM)]
    parts = []
    for k, s in enumerate(sources):
        text = quoted(s).cast("string")
        present = F.when(text != "", text)
        all_ok = lambda ok: F.coalesce(F.bool_and(F.when(present.isNotNull(), ok)), F.lit(True))
        parts.append(
            F.struct(
                F.lit(k).alias("position"),
                F.lit(s).alias("source"),
                F.count("*").alias("total"),
                (F.count("*") - F.count(present)).alias("missing"),
                all_ok(F.lower(present).isin("true", "false")).alias("is_boolean"),
                all_ok(integer(present)["error"].isNull()).alias("is_integer"),
                all_ok(decimal(present, INFER_SCALE)["error"].isNull()).alias("is_decimal"),
                F.coalesce(F.max(F.length(F.regexp_extract(present, r"\.([0-9]+)$", 1))), F.lit(0)).alias("places"),
                all_ok(date(present, "%Y-%m-%d")["error"].isNull()).alias("is_date"),
            )
        )
    rows = raw.where(F.col(PROBLEM).isNull()) if PROBLEM in raw.columns else raw
    return rows.agg(F.array(*parts).alias("facts")).select(F.inline("facts"))


def type_column(facts: DataFrame) -> DataFrame:
    """The facts with the inferred type: boolean, integer, decimal, date, string, in this order."""
    kind = (
        F.when(F.col("total") == F.col("missing"), "string")
        .when(F.col("is_boolean"), "boolean")
        .when(F.col("is_integer"), "integer")
        .when(F.col("is_decimal"), "decimal")
        .when(F.col("is_date"), "date")
        .otherwise("string")
    )
    return facts.withColumn("type", kind)


def infer_schema(raw: DataFrame, name: str = "inferred") -> Schema:
    taken: set[str] = set()
    columns = []
    for f in type_column(column_facts(raw)).orderBy("position").collect():  # one row per column
        own = clean_name(f["source"], taken)
        taken.add(own)
        scale = max(f["places"], 0) if f["type"] == "decimal" else None
        columns.append(
            Column(own, f["type"], f["source"], required=f["total"] > 0 and not f["missing"], pii=bool(PII_HINT.search(f["source"])), scale=scale)
        )
    return Schema(name, tuple(columns), version=0, inferred=True)


def drift(schema: Schema, file_columns: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra): sources of the schema that the file lacks, file columns that the schema does not use."""
    used = [c.src for c in schema.columns]
    return [s for s in used if s not in set(file_columns)], [c for c in file_columns if c not in set(used)]
