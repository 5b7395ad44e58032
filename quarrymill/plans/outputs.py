"""Outputs of a run: clean rows, quarantine, issues, report. Files that a person opens are guarded against formulas."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.coerce import formula_guard
from quarrymill.model import ROW, Policy, Schema
from quarrymill.operators.validate import MASKED, PROBLEM, issues, quarantined, valid
from quarrymill.plans.canon import file_sha256

ISSUE_CAP = 1000
PREVIEW = (20, 40, 80)


def csv_safe(v):
    """The formula guard for single Python values."""
    if not isinstance(v, str) or not v:
        return v
    risky = v[0] in "=@\t\r" or v[0] in "+-" and not re.fullmatch(r"[+-][\d ()./-]*", v)
    return "'" + v if risky else v


def clean_cells(checked: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """The texts of clean.csv: ISO dates, decimals as written, true and false, masked personal values, guarded strings."""
    cells = []
    for c in schema.columns:
        v, text = F.col(c.name), F.col("_text")[c.name]
        if c.pii and policy.mask_pii:
            out = F.when(v.isNotNull(), MASKED)
        elif c.type == "decimal":
            out = F.when(v.isNotNull(), F.regexp_replace(text, r"^\+", ""))
        elif c.type == "string":
            out = formula_guard(v)
        else:
            out = v.cast("string")
        cells.append(out.alias(c.name))
    return valid(checked).select(ROW, *cells)


def quarantine_rows(checked: DataFrame, schema: Schema, policy: Policy) -> DataFrame:
    """row, rules, messages and the original cells, masked and guarded."""
    hide = {c.src for c in schema.columns if c.pii and policy.mask_pii}
    kept = checked.schema["_raw"].dataType
    names = kept.names if hasattr(kept, "names") else []
    text = lambda n: F.col("_raw")[n]
    cells = [(F.when(text(n).isNotNull(), MASKED) if n in hide else formula_guard(text(n))).alias(csv_safe(n)) for n in names]
    return quarantined(checked).select(
        F.col(ROW).alias("row"),
        F.array_join(F.array_sort(F.array_distinct(F.col("_issues")["rule"])), ";").alias("rules"),
        F.array_join(F.transform("_issues", lambda i: F.concat_ws(": ", F.when(i["column"] != "", i["column"]), i["message"])), " | ").alias("messages"),
        *cells,
    )


def write_ordered(df: DataFrame, order: str, path: str, keep_order_column: bool = False) -> int:
    """One CSV in file order with CRLF and minimal quoting: partitions are sorted on the workers and streamed one by one."""
    names = [c for c in df.columns if keep_order_column or c != order]
    temp, n = f"{path}.part", 0
    with open(temp, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(names)
        at = [df.columns.index(c) for c in names]
        for r in df.orderBy(order).toLocalIterator(prefetchPartitions=True):
            w.writerow(["" if r[k] is None else r[k] for k in at])
            n += 1
    os.replace(temp, path)
    return n


def write_distributed(df: DataFrame, path: str) -> None:
    """The scalable form of the clean rows: one Parquet part per task."""
    df.write.parquet(path)


def write_quarantine(run_dir: str, checked: DataFrame, schema: Schema, policy: Policy) -> None:
    write_ordered(quarantine_rows(checked, schema, policy), "row", f"{run_dir}/quarantine.csv", keep_order_column=True)
    first = issues(checked).orderBy(ROW, "position").limit(ISSUE_CAP).collect()
    docs = [{"row": r[ROW], "column": r["column"], "rule": r["rule"], "message": r["message"], "value": r["value"]} for r in first]
    write_json(f"{run_dir}/issues.json", docs)


def write_json(path: str, doc) -> None:
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.part", path)


def preview(clean: DataFrame) -> list[dict]:
    rows, columns, width = PREVIEW
    names = [c for c in clean.columns if c != ROW][:columns]
    return [r.asDict() for r in clean.orderBy(ROW).limit(rows).select(*(F.substring(n, 1, width).alias(n) for n in names)).collect()]


def metric_csv(metric: dict) -> bytes:
    """A metric's rows for a spreadsheet: UTF-8 with a mark, strings guarded."""
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow([csv_safe(c) for c in metric["columns"]])
    for r in metric["rows"]:
        w.writerow([csv_safe(v) if isinstance(v, str) else "" if v is None else v for v in r])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def metrics_zip(metrics: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, m in sorted(metrics.items()):
            z.writestr(f"{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}.csv", metric_csv(m))
    return out.getvalue()


def report(doc: dict) -> str:
    """The run as Markdown: status, source, rows, warnings, checks and their limits, metrics."""
    esc = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = doc.get("rows", {})
    lines = [f"# Run {doc['run_id']}", "", f"Status: **{doc['status']}**", f"Policy: {doc['policy']}", f"Source: {esc(os.path.basename(doc['input']))}"]
    lines += [f"SHA-256: `{doc.get('source_sha256', '')}`", "", "## Rows", "", "| total | valid | quarantined | error rate |", "|---|---|---|---|"]
    lines.append(f"| {rows.get('total', '')} | {rows.get('valid', '')} | {rows.get('quarantined', '')} | {rows.get('error_rate', '')} |")
    for title, key in (("Reasons", "reasons"), ("Warnings", "warnings")):
        if doc.get(key):
            lines += ["", f"## {title}", "", *(f"- {esc(x)}" for x in doc[key])]
    lines += ["", "## Checks and limits", "", "- Every row was checked against the schema; rows with an issue are not in the results."]
    lines.append("- Column statistics were computed by two independent paths" + (" and agree." if not doc.get("mismatches") else " and DISAGREE."))
    lines.append("- Metrics were not recomputed; only their input was verified.")
    for name, m in doc.get("results", {}).get("metrics", {}).items():
        lines += ["", f"## {esc(name)}", "", esc(m["description"]), "", "| " + " | ".join(map(esc, m["columns"])) + " |", "|" + "---|" * len(m["columns"])]
        lines += ["| " + " | ".join(map(esc, r)) + " |" for r in m["rows"]]
    return "\n".join(lines) + "\n"


__all__ = ["PROBLEM", "clean_cells", "file_sha256", "metric_csv", "metrics_zip", "preview", "quarantine_rows", "report", "write_ordered", "write_quarantine"]
