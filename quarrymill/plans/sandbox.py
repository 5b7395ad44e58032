"""Metrics: one read-only SELECT over the table ``data``, checked on the parsed and analysed plan before it runs."""

from __future__ import annotations

import re
import threading
import uuid
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from quarrymill.errors import MetricError
from quarrymill.model import Analysis, Metric
from quarrymill.plans import dialect
from quarrymill.plans.canon import canonical

RESULT_CAP = 10_000
TIMEOUT_S = 30.0
ERROR_CHARS = 160
VIEW = "data"
#: Nodes that a parsed read-only query consists of (simple class names); anything else is refused.
_PLAN_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedWith", "WithCTE", "CTERelationDef", "CTERelationRef", "Join", "LateralJoin", "AsOfJoin", "Union", "Intersect", "Except", "Window",
    "WithWindowDefinition", "Expand", "Generate", "UnresolvedHaving", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "OneRowRelation$",
    "Range", "UnresolvedTableValuedFunction", "Pivot", "Unpivot", "Tail", "Sample", "BaseAggregate", "UnresolvedOrdinal",
}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "inline", "stack"}
#: Functions that reach the host, its files, its code or its settings.
_DENIED = {
    "reflect", "java_method", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user",
    "version", "current_catalog", "current_database", "current_schema", "raise_error", "assert_true", "monotonically_increasing_id", "spark_partition_id", "from_avro", "to_avro",
}


def strip_comments(sql: str) -> str:
    """The text without comments; quoted text stays as it is."""
    keep = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*[\s\S]*?\*/")
    return keep.sub(lambda m: " " if m.group().startswith(("--", "/*")) else m.group(), sql)


def isolated(spark: SparkSession, data: DataFrame) -> SparkSession:
    """A session of its own in which ``data`` is the only view and files cannot be named as tables."""
    session = spark.newSession()
    for k, v in (("spark.sql.runSQLOnFiles", "false"), ("spark.sql.ansi.enabled", "true"), ("spark.sql.ansi.doubleQuotedIdentifiers", "true")):
        session.conf.set(k, v)
    jvm = spark.sparkContext._jvm
    frame = jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, data._jdf.queryExecution().analyzed())
    DataFrame(frame, session).createOrReplaceTempView(VIEW)
    return session


def _children(node):
    for seq in (node.children(), node.innerChildren()):
        for k in range(seq.size()):
            yield seq.apply(k)


def _walk(plan, ctes: set[str]) -> None:
    name = plan.getClass().getSimpleName()
    if name not in _PLAN_NODES:
        raise MetricError(f"not allowed in a metric: {name}")
    if name == "UnresolvedRelation":
        parts = plan.multipartIdentifier()
        if parts.size() != 1 or parts.apply(0).lower() not in ctes | {VIEW}:
            raise MetricError("a metric may read only the table data")
    if name == "UnresolvedTableValuedFunction" and plan.name().mkString(".").lower() not in _TABLE_FUNCTIONS:
        raise MetricError("table function not allowed in a metric")
    if name == "UnresolvedWith":
        rel, own = plan.cteRelations(), set(ctes)
        for k in range(rel.size()):
            pair = rel.apply(k)
            own.add(str(pair._1()).lower())
            _walk(pair._2(), own)
        _walk(plan.child(), own)
        return
    exprs = plan.expressions()
    for k in range(exprs.size()):
        _expression(exprs.apply(k), ctes)
    for child in _children(plan):
        if hasattr(child, "multipartIdentifier") or "plans" in child.getClass().getName() or "Unresolved" in child.getClass().getSimpleName():
            _walk(child, ctes)


def _expression(e, ctes: set[str]) -> None:
    name = e.getClass().getSimpleName()
    if name == "UnresolvedFunction":
        parts = e.nameParts()
        if parts.size() != 1 or parts.apply(0).lower() in _DENIED:
            raise MetricError("function not allowed in a metric")
    if name in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        _walk(e.plan(), ctes)
    children = e.children()
    for k in range(children.size()):
        _expression(children.apply(k), ctes)
    if name == "InSubquery":
        _walk(e.query().plan(), ctes)


def check(session: SparkSession, sql: str) -> str:
    """The statement to run, or MetricError: exactly one SELECT or WITH over ``data`` without a way to the host."""
    text = strip_comments(sql).strip()
    if text.endswith(";"):
        text = text[:-1].rstrip()
    if not re.match(r"(?i)\(?\s*(select|with|values)\b", text) or re.match(r"(?i)\(?\s*values\b", text):
        raise MetricError("a metric is one SELECT or WITH statement")
    text = dialect.translate(text)
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise MetricError("the statement does not parse") from e
    _walk(plan, set())
    return text


def jsonable(v):
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, float) and v != v:
        return "nan"
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def ordered(frame: DataFrame) -> bool:
    """Whether the outermost operators sort the result."""
    plan = frame._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit", "Project", "SubqueryAlias", "WithCTE", "Offset"):
        plan = plan.plan() if plan.getClass().getSimpleName() == "WithCTE" else plan.child()
    return plan.getClass().getSimpleName() == "Sort"


def run_one(session: SparkSession, metric: Metric, timeout_s: float = TIMEOUT_S, cap: int = RESULT_CAP) -> dict:
    """The metric's columns and rows; more rows than the cap, or more time than the limit, is an error."""
    text = check(session, metric.sql)
    sc, tag = session.sparkContext, f"metric-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout_s, lambda: sc.cancelJobsWithTag(tag))
    sc.addJobTag(tag)
    timer.start()
    try:
        frame = session.sql(text)
        sort = ordered(frame)
        rows = frame.limit(cap + 1).collect()
        names = list(frame.columns)
    except MetricError:
        raise
    except Exception as e:  # the class only: an engine's message may quote a value
        kind = e.getCondition() if hasattr(e, "getCondition") and e.getCondition() else type(e).__name__
        raise MetricError(f"the metric failed: {kind}"[:ERROR_CHARS]) from None
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if len(rows) > cap:
        raise MetricError(f"the metric returns more than {cap} rows")
    out = [[jsonable(v) for v in r] for r in rows]
    if not sort:
        out.sort(key=canonical)
    return {"description": metric.description, "sql": metric.sql, "columns": names, "rows": out}


def run_metrics(spark: SparkSession, data: DataFrame, analysis: Analysis, timeout_s: float = TIMEOUT_S) -> dict:
    session = isolated(spark, data)
    return {m.name: run_one(session, m, timeout_s) for m in analysis.metrics}


def fit(spark: SparkSession, empty: DataFrame, analysis: Analysis) -> dict[str, str | None]:
    """Per metric None if it binds against an empty table of these columns, else what is wrong; nothing is run."""
    session = isolated(spark, empty.limit(0))
    out: dict[str, str | None] = {}
    for m in analysis.metrics:
        try:
            session.sql(check(session, m.sql)).schema  # noqa: B018
            out[m.name] = None
        except MetricError as e:
            out[m.name] = str(e)
        except Exception as e:
            out[m.name] = f"does not bind: {getattr(e, 'getCondition', lambda: type(e).__name__)()}"[:ERROR_CHARS]
    return out
