"""Schemas, policies and metric specifications: strict loading, fingerprints, Spark types."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import types as T

from quarrymill.errors import PolicyError, SchemaError
from quarrymill.functions import plain

TYPES = ("string", "integer", "decimal", "date", "boolean")
DEFAULT_SCALE, MAX_SCALE, PRECISION = 6, 18, 38
DEFAULT_DATE = "%Y-%m-%d"
ROW = "_row"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_COLUMN_KEYS = {
    "name", "type", "source", "required", "unique", "pii", "min", "max", "scale", "format", "pattern", "max_length", "allowed", "description",
}
_SCHEMA_KEYS = {"name", "version", "null_tokens", "columns", "provenance", "description"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    source: str | None = None
    required: bool = False
    unique: bool = False
    pii: bool = False
    min: object = None
    max: object = None
    scale: int | None = None
    format: str | None = None
    pattern: str | None = None
    max_length: int | None = None
    allowed: tuple | None = None
    description: str = ""

    @property
    def src(self) -> str:
        return self.source or self.name

    @property
    def places(self) -> int:
        return DEFAULT_SCALE if self.scale is None else self.scale

    @property
    def date_format(self) -> str:
        return self.format or DEFAULT_DATE

    @property
    def spark_type(self) -> T.DataType:
        return {
            "string": T.StringType(),
            "integer": T.LongType(),
            "decimal": T.DecimalType(PRECISION, self.places),
            "date": T.DateType(),
            "boolean": T.BooleanType(),
        }[self.type]

    def parse(self, text: str):
        return plain.parse(self.type, text, fmt=self.date_format, scale=self.places)


@dataclass(frozen=True)
class Schema:
    name: str
    columns: tuple[Column, ...]
    version: int = 1
    null_tokens: tuple[str, ...] = ("",)
    inferred: bool = False
    provenance: dict | None = field(default=None, compare=False)

    def to_dict(self) -> dict:
        def one(c: Column) -> dict:
            out = {"name": c.name, "type": c.type}
            for f in dataclasses.fields(Column)[2:]:
                v = getattr(c, f.name)
                if v != f.default:
                    out[f.name] = [_plain_value(x) for x in v] if f.name == "allowed" else _plain_value(v)
            return out

        doc = {
            "name": self.name,
            "version": self.version,
            "null_tokens": list(self.null_tokens),
            "columns": [one(c) for c in self.columns],
        }
        return doc | ({"provenance": self.provenance} if self.provenance else {})

    def fingerprint(self) -> str:
        text = json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type) for c in self.columns])

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def _plain_value(v):
    if isinstance(v, Decimal):
        return format(v, "f")
    return v.isoformat() if isinstance(v, date) else v


def nested_repeat(pattern: str) -> bool:
    """Whether an unbounded repeat stands inside another, which may take exponential time."""
    import re._constants as C
    import re._parser as parser

    def walk(items, inside: bool) -> bool:
        for op, arg in items:
            if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, body = arg
                loose = high is C.MAXREPEAT or high > 1000
                if loose and inside or walk(body, inside or loose):
                    return True
            elif op is C.BRANCH:
                if any(walk(b, inside) for b in arg[1]):
                    return True
            elif op is C.SUBPATTERN:
                if walk(arg[3], inside):
                    return True
            elif op in (C.ASSERT, C.ASSERT_NOT):
                if walk(arg[1], inside):
                    return True
            elif op is C.ATOMIC_GROUP:
                if walk(arg, inside):
                    return True
            elif op is C.GROUPREF_EXISTS:
                if any(b and walk(b, inside) for b in arg[1:]):
                    return True
        return False

    return walk(parser.parse(pattern), False)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SchemaError(message)


def _column(raw: object, taken: set[str]) -> Column:
    _need(isinstance(raw, dict), "every column must be an object")
    name = raw.get("name")
    _need(isinstance(name, str) and bool(_NAME.match(name)), "a column name must be an ASCII identifier")
    _need(not set(raw) - _COLUMN_KEYS, f"column {name}: unknown keys {sorted(set(raw) - _COLUMN_KEYS)}")
    _need(name.lower() != ROW, f"column {name}: the name is reserved")
    _need(name.lower() not in taken, f"column {name}: the name is used twice")
    kind = raw.get("type")
    _need(kind in TYPES, f"column {name}: type must be one of {', '.join(TYPES)}")
    for k in ("required", "unique", "pii"):
        _need(isinstance(raw.get(k, False), bool), f"column {name}: {k} must be true or false")
    for k in ("source", "format", "pattern", "description"):
        _need(raw.get(k) is None or isinstance(raw[k], str), f"column {name}: {k} must be text")
    for k in ("scale", "max_length"):
        v = raw.get(k)
        _need(v is None or isinstance(v, int) and not isinstance(v, bool) and v >= 0, f"column {name}: {k} must be a whole number")
    _need(raw.get("scale") is None or kind == "decimal", f"column {name}: scale is for decimals")
    _need(raw.get("scale") is None or raw["scale"] <= MAX_SCALE, f"column {name}: scale must be 0 to {MAX_SCALE}")
    _need(raw.get("format") is None or kind == "date", f"column {name}: format is for dates")
    if raw.get("pattern") is not None:
        try:
            loose = nested_repeat(raw["pattern"])
        except re.error as e:
            raise SchemaError(f"column {name}: the pattern does not compile") from e
        _need(not loose, f"column {name}: the pattern nests unbounded repeats")
    col = Column(**{k: v for k, v in raw.items() if k not in ("min", "max", "allowed")})
    bounds = {}
    for k in ("min", "max"):
        if raw.get(k) is not None:
            _need(kind in ("integer", "decimal", "date"), f"column {name}: {k} is for numbers and dates")
            bounds[k] = _typed(col, raw[k], k)
    if raw.get("allowed") is not None:
        _need(isinstance(raw["allowed"], list) and bool(raw["allowed"]), f"column {name}: allowed must be a list")
        bounds["allowed"] = tuple(_typed(col, v, "allowed") for v in raw["allowed"])
    return dataclasses.replace(col, **bounds)


def _typed(col: Column, raw: object, key: str):
    _need(isinstance(raw, (str, int, float, bool)), f"column {col.name}: {key} has a wrong type")
    text = str(raw).lower() if isinstance(raw, bool) else format(Decimal(repr(raw)), "f") if isinstance(raw, float) else str(raw)
    value, error = col.parse(text)
    _need(error is None, f"column {col.name}: {key}: {error}")
    return value


def schema_from_dict(doc: object) -> Schema:
    """A schema from its document; wrong types and unknown keys are refused, never coerced."""
    _need(isinstance(doc, dict), "the schema must be an object")
    _need(not set(doc) - _SCHEMA_KEYS, f"unknown keys {sorted(set(doc) - _SCHEMA_KEYS)}")
    _need(isinstance(doc.get("columns"), list) and bool(doc["columns"]), "the schema needs a list of columns")
    _need(isinstance(doc.get("name", "unnamed"), str), "name must be text")
    version = doc.get("version", 1)
    _need(isinstance(version, int) and not isinstance(version, bool), "version must be a whole number")
    tokens = doc.get("null_tokens", [""])
    _need(isinstance(tokens, list) and all(isinstance(t, str) for t in tokens), "null_tokens must be a list of texts")
    columns: list[Column] = []
    for raw in doc["columns"]:
        columns.append(_column(raw, {c.name.lower() for c in columns}))
    sources = [c.src for c in columns]
    _need(len(set(sources)) == len(sources), "two columns read the same source")
    return Schema(doc.get("name", "unnamed"), tuple(columns), version, tuple(tokens), provenance=doc.get("provenance"))


def load_schema(path: str) -> Schema:
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
    except (OSError, ValueError) as e:
        raise SchemaError("the schema file cannot be read as JSON") from e
    return schema_from_dict(doc)


@dataclass(frozen=True)
class Metric:
    name: str
    sql: str
    description: str = ""


@dataclass(frozen=True)
class Analysis:
    metrics: tuple[Metric, ...] = ()
    profile: bool = True


def analysis_from_dict(doc: object) -> Analysis:
    _need(isinstance(doc, dict) and not set(doc) - {"metrics", "profile", "name", "description"}, "the analysis must be an object of metrics and profile")
    _need(isinstance(doc.get("profile", True), bool), "profile must be true or false")
    metrics = []
    for m in doc.get("metrics", []):
        ok = isinstance(m, dict) and not set(m) - {"name", "sql", "description"}
        _need(ok and all(isinstance(m.get(k, ""), str) for k in ("name", "sql", "description")), "a metric has a name, sql and a description")
        _need(bool(m.get("name")) and bool(m.get("sql")), "a metric needs a name and sql")
        _need(m["name"] not in {x.name for x in metrics}, "two metrics have the same name")
        metrics.append(Metric(m["name"], m["sql"], m.get("description", "")))
    return Analysis(tuple(metrics), doc.get("profile", True))


@dataclass(frozen=True)
class Policy:
    name: str
    max_file_mb: int
    schema_mode: str
    extra_columns: str
    row_errors: str
    max_error_rate: float
    mask_pii: bool
    signoff: bool
    egress: str
    max_memory_gb: float = 6
    max_distributed_gb: float = 200

    def with_limits(self, max_file_mb: int | None = None, max_memory_gb: float | None = None) -> Policy:
        out = self
        for k, v in (("max_file_mb", max_file_mb), ("max_memory_gb", max_memory_gb)):
            if v is not None:
                if v <= 0:
                    raise PolicyError(f"{k} must be positive")
                out = dataclasses.replace(out, **{k: v})
        if max_file_mb is not None:
            out = dataclasses.replace(out, max_distributed_gb=max_file_mb / 1024)
        return out


#: The tiers' settings (fixed values).
POLICIES = {
    "low": Policy("low", 300, "infer", "warn", "quarantine", 1.0, False, False, "cloud"),
    "business": Policy("business", 300, "confirm", "warn", "quarantine", 0.05, True, False, "cloud_masked"),
    "regulated": Policy("regulated", 150, "registered", "block", "block", 0.0, True, True, "none"),
}


def get_policy(name: str) -> Policy:
    if name not in POLICIES:
        raise PolicyError(f"unknown policy; known are {', '.join(POLICIES)}")
    return POLICIES[name]
