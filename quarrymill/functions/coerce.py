"""Strict coercion as column expressions: text to (value, error), all inside the JVM.

Casts alone are too lenient (they trim, round and accept exponents), so every cast is guarded by the exact form. Dates whose
format holds only %Y, %m, %d and literals are native; any other format goes through a vectorised Python function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column as C
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import plain
from quarrymill.model import Column


def integer_value(text: C) -> C:
    return F.when(text.rlike(r"\A[+-]?(?:0|[1-9][0-9]{0,18})\z"), text.try_cast("bigint"))


def integer_error(text: C) -> C:
    return (
        F.when(~text.rlike(r"\A[+-]?[0-9]+\z"), plain.BAD_INTEGER)
        .when(text.rlike(r"\A[+-]?0[0-9]"), plain.ZEROS_INTEGER)
        .otherwise(plain.WIDE_INTEGER)
    )


def decimal_value(text: C, scale: int) -> C:
    part = rf"[0-9]{{1,{scale}}}0*" if scale else "0+"
    return F.when(text.rlike(rf"\A[+-]?(?:0|[1-9][0-9]{{0,{37 - scale}}})(?:\.{part})?\z"), text.try_cast(T.DecimalType(38, scale)))


def decimal_error(text: C, scale: int) -> C:
    return (
        F.when(~text.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z"), plain.BAD_DECIMAL)
        .when(text.rlike(r"\A[+-]?0[0-9]"), plain.ZEROS_DECIMAL)
        .when(F.length(F.regexp_extract(text, r"\A[+-]?([0-9]+)", 1)) > 38 - scale, plain.WIDE_DECIMAL)
        .otherwise(plain.FINE_DECIMAL.format(scale))
    )


_DIRECTIVE = re.compile(r"%(.)")
_PARTS = {"Y": (r"[0-9]{4}", r"[0-9]{4}"), "m": (r"[0-9]{2}", r"1[0-2]|0?[1-9]"), "d": (r"[0-9]{2}", r"[12][0-9]|3[01]|0?[1-9]")}


def native_format(fmt: str) -> bool:
    found = _DIRECTIVE.findall(fmt)
    return sorted(found) == ["Y", "d", "m"] and fmt.isascii() and not any(c.isspace() for c in fmt)


def _form(fmt: str, loose: bool) -> str:
    parts = re.split(r"%.", fmt)
    body = re.escape(parts[0])
    for d, rest in zip(_DIRECTIVE.findall(fmt), parts[1:]):
        body += f"({_PARTS[d][loose]})" + re.escape(rest)
    return rf"\A{body}\z"


def _day(text: C, fmt: str, loose: bool) -> C:
    form, order = _form(fmt, loose), _DIRECTIVE.findall(fmt)
    if fmt == "%Y-%m-%d" and not loose:
        return F.when(text.rlike(form) & ~text.startswith("0000"), text.try_cast("date"))
    get = lambda d: F.regexp_extract(text, form, order.index(d) + 1)
    iso = F.concat(get("Y"), F.lit("-"), F.lpad(get("m"), 2, "0"), F.lit("-"), F.lpad(get("d"), 2, "0"))
    return F.when(text.rlike(form) & (get("Y") != "0000"), iso.try_cast("date"))


def date_value(text: C, fmt: str) -> C:
    return _day(text, fmt, False) if native_format(fmt) else _slow_date(text, fmt)["value"]


def date_error(text: C, fmt: str) -> C:
    if not native_format(fmt):
        return _slow_date(text, fmt)["error"]
    return F.when(_day(text, fmt, True).isNull(), plain.BAD_DATE.format(fmt)).otherwise(plain.LOOSE_DATE.format(fmt))


def _slow_date(text: C, fmt: str) -> C:
    @F.pandas_udf("value date, error string")
    def parse(s: pd.Series) -> pd.DataFrame:
        got = [plain.parse("date", x, fmt=fmt) if x is not None else (None, None) for x in s]
        return pd.DataFrame({"value": [v for v, _ in got], "error": [e for _, e in got]})

    return parse(text)


def boolean_value(text: C) -> C:
    low = F.lower(text)
    return F.when(low.isin(*plain.TRUE), True).when(low.isin(*plain.FALSE), False)


def value(text: C, col: Column) -> C:
    """The typed value of a cell's text, or null where it does not parse: one test of the form and one cast."""
    if col.type == "integer":
        return integer_value(text)
    if col.type == "decimal":
        return decimal_value(text, col.places)
    if col.type == "date":
        return date_value(text, col.date_format)
    return boolean_value(text) if col.type == "boolean" else text


def error(text: C, parsed: C, col: Column) -> C:
    """What is wrong with a text that did not parse; looked into only then."""
    if col.type == "string":
        return F.lit(None).cast("string")
    if col.type == "integer":
        why = integer_error(text)
    elif col.type == "decimal":
        why = decimal_error(text, col.places)
    elif col.type == "date":
        why = date_error(text, col.date_format)
    else:
        why = F.lit(plain.BAD_BOOLEAN)
    return F.when(text.isNotNull() & parsed.isNull(), why)


def coerce(text: C, col: Column) -> C:
    """struct(value, error) of a cell's text."""
    parsed = value(text, col)
    return F.struct(parsed.cast(col.spark_type).alias("value"), error(text, parsed, col).alias("error"))


def integer(text: C) -> C:
    return coerce(text, Column("c", "integer"))


def decimal(text: C, scale: int) -> C:
    return coerce(text, Column("c", "decimal", scale=scale))


def date(text: C, fmt: str) -> C:
    return coerce(text, Column("c", "date", format=fmt))


def boolean(text: C) -> C:
    return coerce(text, Column("c", "boolean"))


def quantize(value: C, scale: int) -> C:
    return F.round(value, scale)


def formula_guard(text: C) -> C:
    """A leading quote before text that a spreadsheet would run as a formula."""
    risky = text.rlike(r"\A[=@\t\r]") | (text.rlike(r"\A[+-]") & ~text.rlike(r"(?U)\A[+-][\d ()./-]*\z"))
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)
