"""One run: file -> raw -> checked rows -> gates -> metrics -> reconciliation -> outputs, with an audit trail."""

from __future__ import annotations

import os
import unicodedata
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quarrymill.errors import MillError, SignoffError
from quarrymill.model import Analysis, Schema, get_policy
from quarrymill.operators import infer, profile, validate
from quarrymill.plans import outputs, sandbox
from quarrymill.plans.audit import AuditLog, default_actor
from quarrymill.plans.canon import file_sha256, sha256_of
from quarrymill.session import write_once
from quarrymill.sources.preflight import unchanged
from quarrymill.sources.registry import read_source

COMPLETED, WARNED, PENDING = "COMPLETED", "COMPLETED_WITH_WARNINGS", "PENDING_SIGNOFF"
CONFIRM, BLOCKED, FAILED = "NEEDS_SCHEMA_CONFIRMATION", "BLOCKED", "FAILED"
EXIT = {COMPLETED: 0, WARNED: 0, PENDING: 0, CONFIRM: 1, BLOCKED: 2, FAILED: 3}


@dataclass
class Stop(Exception):
    status: str
    reasons: list[str]


def audit_log(workdir: str) -> AuditLog:
    return AuditLog(os.path.join(workdir, "audit.jsonl"))


def run(
    spark: SparkSession,
    path: str,
    *,
    workdir: str,
    policy: str = "business",
    schema: Schema | None = None,
    analysis: Analysis | None = None,
    accept_inferred: bool = False,
    actor: str | None = None,
    max_file_mb: int | None = None,
    max_memory_gb: float | None = None,
    **read_options,
) -> dict:
    """The run's document, also written as result.json; refusals become a status, never a traceback."""
    tier = get_policy(policy).with_limits(max_file_mb, max_memory_gb)
    run_id, log = uuid.uuid4().hex[:16], audit_log(workdir)
    log.append("run_started", run_id, {"input": os.path.basename(path), "policy": policy}, actor)
    run_dir = os.path.join(workdir, "runs", run_id)
    os.makedirs(run_dir)
    doc: dict = {"run_id": run_id, "input": path, "policy": policy, "warnings": [], "reasons": [], "status": FAILED, "mismatches": []}
    try:
        _run(spark, path, tier, schema, analysis or Analysis(), accept_inferred, read_options, run_dir, run_id, log, actor, doc)
    except Stop as e:
        doc["status"], doc["reasons"] = e.status, e.reasons
    except MillError as e:
        doc["status"], doc["reasons"] = FAILED, [str(e)]
    except Exception as e:  # no data value may leak through an engine's message
        doc["status"], doc["reasons"] = FAILED, [f"unexpected: {type(e).__name__}"]
    outputs.write_json(f"{run_dir}/result.json", doc)
    with open(f"{run_dir}/report.md", "w", encoding="utf-8") as f:
        f.write(outputs.report(doc))
    log.append("run_finished", run_id, {"status": doc["status"], "results_sha256": doc.get("results_sha256")}, actor)
    return doc


def _run(spark, path, tier, schema, analysis, accept, options, run_dir, run_id, log, actor, doc) -> None:
    if schema is None and tier.schema_mode == "registered":
        raise Stop(BLOCKED, ["the policy needs a registered schema"])
    distributed = os.path.splitext(path)[1].lower() in (".csv", ".tsv", ".jsonl", ".ndjson")
    limit = int(tier.max_distributed_gb * (1 << 30)) if distributed else tier.max_file_mb << 20
    raw, info = read_source(spark, path, max_bytes=limit, max_memory_bytes=tier.max_memory_gb * (1 << 30), **options)
    doc |= {"source_sha256": info.sha256, "format": info.format, "columns": info.columns}
    doc["warnings"] += info.warnings
    log.append("ingest_done", run_id, {"sha256": info.sha256, "bytes": info.bytes}, actor)
    if schema is None:
        schema = infer.infer_schema(raw)
        outputs.write_json(f"{run_dir}/proposed_schema.json", schema.to_dict())
        if tier.schema_mode == "confirm" and not accept:
            raise Stop(CONFIRM, ["the inferred schema needs to be accepted"])
        doc["warnings"].append("the schema was inferred")
    doc["schema_sha256"] = schema.fingerprint()
    missing, extra = infer.drift(schema, info.columns)
    log.append("schema_resolved", run_id, {"schema": schema.fingerprint(), "missing": missing, "extra": extra}, actor)
    needed = [c.src for c in schema.columns if c.required and c.src in missing]
    if needed:
        raise Stop(BLOCKED, [f"required column missing: {c}" for c in needed])
    doc["warnings"] += [f"optional column missing: {c}" for c in missing]
    if extra and tier.extra_columns == "block":
        raise Stop(BLOCKED, [f"column not in the schema: {c}" for c in extra])
    doc["warnings"] += [f"column not in the schema: {c}" for c in extra]
    checked = validate.validate(raw, schema, tier).persist()
    try:
        counts = validate.summary(checked).first().asDict()
        doc["rows"] = counts
        doc["issues_by_rule"] = {r["rule"]: r["n"] for r in sorted(validate.counts_by_rule(checked).collect(), key=lambda r: r["rule"])}
        log.append("validation_done", run_id, {"rows": {k: counts[k] for k in ("total", "valid", "quarantined")}}, actor)
        outputs.write_quarantine(run_dir, checked, schema, tier)
        reasons = []
        if not counts["total"]:
            reasons.append("the file holds no data rows")
        elif not counts["valid"]:
            reasons.append("no row is valid")
        elif counts["quarantined"] and tier.row_errors == "block":
            reasons.append("rows with errors are not allowed")
        elif counts["error_rate"] > tier.max_error_rate:
            reasons.append("the share of rows with errors is above the limit")
        if reasons:
            raise Stop(BLOCKED, reasons)
        if counts["quarantined"]:
            doc["warnings"].append(f"{counts['quarantined']} rows were set aside")
        data = write_once(validate.engine_table(checked, schema, tier), "data")
        results: dict = {"metrics": sandbox.run_metrics(spark, data, analysis)}
        if analysis.profile:
            full = validate.valid(checked).select(*(c.name for c in schema.columns))
            results["profile"], doc["mismatches"] = profile.reconcile(full, schema, tier)
        doc["results"], doc["results_sha256"] = results, sha256_of(results)
        log.append("analysis_done", run_id, {"results_sha256": doc["results_sha256"]}, actor)
        if doc["mismatches"]:
            raise Stop(BLOCKED, [f"the two statistics paths disagree: {m}" for m in doc["mismatches"]])
        unchanged(info)
        clean = f"{run_dir}/clean.csv"
        n = outputs.write_ordered(outputs.clean_cells(checked, schema, tier), "_row", clean)
        doc["clean"] = {"rows": n, "sha256": file_sha256(clean)}
        log.append("export_done", run_id, doc["clean"], actor)
    finally:
        checked.unpersist()
    doc["status"] = PENDING if tier.signoff else WARNED if doc["warnings"] else COMPLETED


def clean_person(name: str) -> str:
    out = " ".join(unicodedata.normalize("NFKC", name or "").split())
    if not out:
        raise SignoffError("a name is needed")
    return out


def same_person(a: str, b: str) -> bool:
    return clean_person(a).casefold() == clean_person(b).casefold()


def signoff(workdir: str, run_id: str, reviewer: str, note: str = "") -> dict:
    """A second person's approval: once, of an unchanged result, by someone other than the one who ran it."""
    import json

    log, reviewer = audit_log(workdir), clean_person(reviewer)
    run_dir = os.path.join(workdir, "runs", os.path.basename(run_id))

    def refuse(message: str):
        log.append("signoff_refused", run_id, {"reason": message}, reviewer)
        raise SignoffError(message)

    try:
        with open(f"{run_dir}/result.json", encoding="utf-8") as f:
            doc = json.load(f)
    except OSError:
        refuse("the run does not exist")
    if doc["status"] != PENDING:
        refuse("the run does not wait for a sign-off")
    if sha256_of(doc["results"]) != doc["results_sha256"] or file_sha256(f"{run_dir}/clean.csv") != doc["clean"]["sha256"]:
        refuse("the results changed after the run")

    def guard(records: list[dict]) -> None:
        own = [r for r in records if r["run_id"] == run_id]
        if any(r["event"] == "signoff" for r in own):
            raise SignoffError("the run is signed off already")
        started = next((r for r in own if r["event"] == "run_started"), None)
        if started is None or same_person(started["actor"], reviewer):
            raise SignoffError("the reviewer must be another person than the one who ran it")
        finished = next((r for r in own if r["event"] == "run_finished"), None)
        if finished is None or finished["data"].get("results_sha256") != doc["results_sha256"]:
            raise SignoffError("the results are not those of the audited run")

    try:
        return log.append("signoff", run_id, {"note": note, "results_sha256": doc["results_sha256"]}, reviewer, guard)
    except SignoffError as e:
        refuse(str(e))


__all__ = ["AuditLog", "audit_log", "default_actor", "run", "signoff"]
