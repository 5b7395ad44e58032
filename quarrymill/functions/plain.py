"""Strict parsing of single values in Python: bounds and allowed values of schemas, and the slow path of dates."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

INT_RANGE = (-(2**63), 2**63 - 1)
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
#: What is said of a value that does not parse (fixed texts).
BAD_INTEGER = "not a valid integer"
ZEROS_INTEGER = "leading zeros: identifiers such as '007' must be declared as type string"
WIDE_INTEGER = "integer out of 64-bit range"
BAD_DECIMAL = "not a valid decimal (no thousands separators, exponents or comma decimals)"
ZEROS_DECIMAL = "leading zeros: identifiers such as '01234' must be declared as type string"
WIDE_DECIMAL = "decimal too large"
FINE_DECIMAL = "more than {} decimal places (would require rounding)"
BAD_DATE = "not a valid date for format {}"
LOOSE_DATE = "date not in canonical form for format {}"
BAD_BOOLEAN = "not a valid boolean"

_WHOLE = re.compile(r"[+-]?[0-9]+\Z")
_FRACTION = re.compile(r"[+-]?([0-9]+)(?:\.([0-9]+))?\Z")


def parse(kind: str, text: str, fmt: str = "%Y-%m-%d", scale: int = 6) -> tuple[object, str | None]:
    """(value, None) or (None, what is wrong)."""
    if kind == "string":
        return text, None
    if kind == "integer":
        if not _WHOLE.match(text):
            return None, BAD_INTEGER
        digits = text.lstrip("+-")
        if len(digits) > 1 and digits[0] == "0":
            return None, ZEROS_INTEGER
        value = int(text) if len(digits) < 20 else INT_RANGE[1] + 1
        return (value, None) if INT_RANGE[0] <= value <= INT_RANGE[1] else (None, WIDE_INTEGER)
    if kind == "decimal":
        m = _FRACTION.match(text)
        if not m:
            return None, BAD_DECIMAL
        if len(m[1]) > 1 and m[1][0] == "0":
            return None, ZEROS_DECIMAL
        if len(m[1]) > 38 - scale:
            return None, WIDE_DECIMAL
        if len((m[2] or "").rstrip("0")) > scale:
            return None, FINE_DECIMAL.format(scale)
        return Decimal(text), None
    if kind == "date":
        try:
            value = datetime.strptime(text, fmt)
        except ValueError:
            return None, BAD_DATE.format(fmt)
        iso = fmt == "%Y-%m-%d"
        back = value.date().isoformat() if iso else value.strftime(fmt)
        return (value.date(), None) if back == text else (None, LOOSE_DATE.format(fmt))
    low = text.lower()
    return (True, None) if low in TRUE else (False, None) if low in FALSE else (None, BAD_BOOLEAN)
