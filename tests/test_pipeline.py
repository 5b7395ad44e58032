import csv
import json
import os
import sqlite3

import pytest

from quarrymill import cli
from quarrymill.errors import AuditError, MappingError, SignoffError, SourceError
from quarrymill.model import Analysis, Metric, get_policy, schema_from_dict
from quarrymill.operators.validate import PROBLEM
from quarrymill.plans import audit, mapping, pipeline
from quarrymill.sources.preflight import binary_kind, detect_format, inspect, sniff_delimiter
from quarrymill.sources.registry import generate_buyers, read_source
from tests.test_validate import SALES

CLEAN = [
    ["1001", "anna@x.example", "EU", "120.00", "2026-01-05", "true"],
    ["1002", "ben@x.example", "US", "150.00", "2026-01-06", "false"],
    ["1003", "cy@x.example", "APAC", "10.31", "2026-01-07", "true"],
    ["1004", "di@x.example", "US", "200.00", "2026-01-08", "1"],
]
NAMES = [c["name"] for c in SALES["columns"]]
ANALYSIS = Analysis((Metric("by_region", "SELECT region, sum(amount) AS total, count(*) AS n FROM data GROUP BY region"),))


def put(path, rows, names=NAMES, delim=","):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=delim)
        w.writerow(names)
        w.writerows(rows)
    return str(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_agree(spark, tmp_path):
    plain = put(tmp_path / "a.csv", CLEAN + [["only", "two"]])
    text = open(plain, encoding="utf-8").read()
    for name, body in {"bom.csv": "﻿" + text, "cr.csv": text.replace("\r\n", "\r"), "blank.csv": text.replace("\r\n", "\n\n"), "semi.csv": text.replace(",", ";"), "x.tsv": text.replace(",", "\t"), "quoted.csv": text.replace("EU", '"EU"')}.items():
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            f.write(body)
    first, _ = read_source(spark, plain)
    want = rows_of(first)
    assert len(want) == 5 and want[4][1] == "expected 6 fields, got 2"
    for name in ("bom.csv", "cr.csv", "blank.csv", "semi.csv", "x.tsv", "quoted.csv"):
        got, info = read_source(spark, str(tmp_path / name))
        assert rows_of(got) == want, name
    with open(tmp_path / "a.jsonl", "w") as f:
        f.write('{"a": 1.10, "b": {"c": [1, 2]}}\n\nnot json\n{"a": 1, "a": 2}\n{"d": true}\n[1]\n')
    got, info = read_source(spark, str(tmp_path / "a.jsonl"))
    assert info.columns == ["a", "b.c", "d"]
    assert [(r[0], r[1] is None) for r in sorted(got.collect())] == [(1, True), (2, False), (3, False), (4, True), (5, False)]
    assert sorted(got.collect())[0]["a"] == "1.10" and sorted(got.collect())[0]["b.c"] == "[1, 2]"


def test_json_and_dump(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": 1, "rows": [{"a": 0.10, "b": {"c": 1}}, {"a": 1E+2, "z": null}]}')
    got, info = read_source(spark, str(tmp_path / "a.json"))
    assert [r.a for r in got.orderBy("_row").collect()] == ["0.10", "100"] and info.warnings
    (tmp_path / "bad.json").write_text('[{"a": NaN}]')
    (tmp_path / "clash.json").write_text('[{"a": {"b": 1}, "a.b": 2}, 5]')
    with pytest.raises(SourceError):
        read_source(spark, str(tmp_path / "bad.json"))
    got, _ = read_source(spark, str(tmp_path / "clash.json"))
    assert got.where(f"{PROBLEM} IS NOT NULL").count() == 2
    (tmp_path / "d.sql").write_text("CREATE TABLE t(id INTEGER, price DECIMAL(10,2), raw BLOB);\nINSERT INTO t VALUES (1, 0.1, x'ff'), (2, NULL, NULL);\n")
    got, info = read_source(spark, str(tmp_path / "d.sql"))
    assert [tuple(r)[2:] for r in got.orderBy("_row").collect()] == [("1", "0.1", "ff"), ("2", None, None)]
    for attack in ("ATTACH 'x' AS y;", "PRAGMA user_version = 1;", "CREATE VIEW v AS SELECT 1;", "CREATE TABLE t(a); CREATE TRIGGER g AFTER INSERT ON t BEGIN SELECT 1; END;", "SELECT load_extension('x');"):
        (tmp_path / "e.sql").write_text("CREATE TABLE q(a);" + attack)
        with pytest.raises(SourceError):
            read_source(spark, str(tmp_path / "e.sql"))
    assert sqlite3.sqlite_version


def test_refusals(spark, tmp_path):
    cases = {"empty.csv": b"", "nul.csv": b"a,b\n1,\0\n", "utf.csv": b"a,b\n\xff,1\n", "quote.csv": b'a,b\n"un"q,1\n', "twice.csv": b"a,a\n1,2\n", "gap.csv": b"a,,b\n1,2,3\n", "zip.csv": b"PK\x03\x04xx"}
    for name, body in cases.items():
        (tmp_path / name).write_bytes(body)
        with pytest.raises(Exception) as e:
            read_source(spark, str(tmp_path / name))[0].collect()
        assert "SourceError" in repr(e) or "quoting is broken" in str(e.value) or isinstance(e.value, SourceError), name
    assert sniff_delimiter("a;b;c,d")[0] == ";" and sniff_delimiter("a;b,c")[0] == ","
    assert binary_kind(b"%PDF-1", False) is None and binary_kind(b"%PDF-1", True) == "PDF"
    assert detect_format("x", " [1]") == "json"
    with pytest.raises(SourceError):
        inspect(str(tmp_path))


@pytest.mark.parametrize("policy,status", [("low", "COMPLETED_WITH_WARNINGS"), ("business", "BLOCKED"), ("regulated", "BLOCKED")])
def test_tiers(spark, tmp_path, policy, status):
    path = put(tmp_path / "s.csv", CLEAN + [["1004", "x@y.example", "EU", "1", "2026-01-01", "true"]])
    doc = pipeline.run(spark, path, workdir=str(tmp_path / "w"), policy=policy, schema=schema_from_dict(SALES), analysis=ANALYSIS, actor="ann")
    assert doc["status"] == status
    assert os.path.exists(tmp_path / "w/runs" / doc["run_id"] / "clean.csv") == (status != "BLOCKED")
    assert pipeline.audit_log(str(tmp_path / "w")).verify()[0]


def test_regulated_run_and_signoff(spark, tmp_path):
    path, work = put(tmp_path / "s.csv", CLEAN), str(tmp_path / "w")
    doc = pipeline.run(spark, path, workdir=work, policy="regulated", schema=schema_from_dict(SALES), analysis=ANALYSIS, actor="Ann")
    assert doc["status"] == "PENDING_SIGNOFF", doc["reasons"]
    assert doc["results"]["metrics"]["by_region"]["rows"] == [["APAC", "10.31", 1], ["EU", "120.00", 1], ["US", "350.00", 2]]
    run_dir = tmp_path / "w/runs" / doc["run_id"]
    for name in ("clean.csv", "result.json", "report.md", "quarantine.csv"):
        assert "anna@" not in (run_dir / name).read_text()
    with pytest.raises(SignoffError):
        pipeline.signoff(work, doc["run_id"], "ANN ")
    pipeline.signoff(work, doc["run_id"], "Bob")
    with pytest.raises(SignoffError):
        pipeline.signoff(work, doc["run_id"], "Cy")
    events = [r["event"] for r in pipeline.audit_log(work).records()]
    assert events.count("signoff") == 1 and events.count("signoff_refused") == 2
    assert audit.chain_breaks(spark, pipeline.audit_log(work).path).count() == 0


def test_same_result_in_every_format(spark, tmp_path):
    put(tmp_path / "a.csv", CLEAN)
    (tmp_path / "a.json").write_text(json.dumps([dict(zip(NAMES, r)) for r in CLEAN]))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(dict(zip(NAMES, r))) for r in CLEAN))
    hashes = set()
    for name in ("a.csv", "a.json", "a.jsonl"):
        doc = pipeline.run(spark, str(tmp_path / name), workdir=str(tmp_path / "w"), schema=schema_from_dict(SALES), analysis=ANALYSIS)
        assert doc["status"].startswith("COMPLETED"), doc["reasons"]
        hashes.add(doc["results_sha256"])
    assert len(hashes) == 1


def test_gates(spark, tmp_path):
    path, work = put(tmp_path / "s.csv", [r[:3] for r in CLEAN], NAMES[:3]), str(tmp_path / "w")
    assert pipeline.run(spark, path, workdir=work, schema=schema_from_dict(SALES))["status"] == "BLOCKED"
    assert pipeline.run(spark, path, workdir=work, policy="business")["status"] == "NEEDS_SCHEMA_CONFIRMATION"
    assert pipeline.run(spark, path, workdir=work, policy="regulated")["status"] == "BLOCKED"
    assert pipeline.run(spark, path, workdir=work, policy="low")["status"] == "COMPLETED_WITH_WARNINGS"
    assert pipeline.run(spark, str(tmp_path / "none.csv"), workdir=work)["status"] == "FAILED"
    (tmp_path / "head.csv").write_text("a,b\n")
    assert pipeline.run(spark, str(tmp_path / "head.csv"), workdir=work, policy="low")["status"] == "BLOCKED"


def test_audit_detects_edits(tmp_path):
    log = audit.AuditLog(str(tmp_path / "audit.jsonl"))
    for k in range(3):
        log.append("e", str(k), {"n": k}, "ann")
    lines = open(log.path).read().splitlines(keepends=True)
    for changed in (lines[0] + lines[2], lines[1] + lines[0] + lines[2], lines[0].replace('"n":0', '"n":9') + "".join(lines[1:]), "".join(lines)[:-5]):
        with open(log.path, "w") as f:
            f.write(changed)
        ok, intact, _ = log.verify()
        assert not ok and intact == {lines[0] + lines[2]: 1, "".join(lines)[:-5]: 2}.get(changed, 0)
        with pytest.raises(AuditError):
            log.append("e")


def test_mapping(spark, tmp_path):
    path = put(tmp_path / "r.csv", CLEAN, ["Order No", "Buyer Email", "Area", "Total (EUR)", "Ordered On", "Paid?"])
    target, log = schema_from_dict(SALES), audit.AuditLog(str(tmp_path / "audit.jsonl"))
    raw, info = read_source(spark, path)
    request = mapping.build_request(raw, target, "shapes+samples")
    mail = next(c for c in request["columns"] if c["name"] == "Buyer Email")
    assert "samples" not in mail and mail["shapes"] and "anna" not in json.dumps(request)
    p = mapping.propose(raw, target, mapping.Heuristic(), get_policy("low"), input_name="r.csv", actor="Ann", audit=log)
    assert {m["target"]: m["source"] for m in p["body"]["items"] if m["verdict"] != "rejected"}["region"] == "Area"
    with pytest.raises(MappingError):
        mapping.approve(p, target, "ann", log, accept_review=True)
    manual = [{"source": s, "target": t} for s, t in (("Ordered On", "order_date"), ("Total (EUR)", "amount"))]
    for m in manual:
        mapping.verify_manual(raw, target, m["source"], m["target"])
    with pytest.raises(MappingError):
        mapping.verify_manual(raw, target, "Area", "amount")
    schema = mapping.approve(p, target, "Bob", log, accept_review=True, manual=manual)
    with pytest.raises(MappingError):
        mapping.approve(p, target, "Cy", log, accept_review=True, manual=manual)
    with pytest.raises(MappingError):
        mapping.check_seal({**p, "body": {**p["body"], "actor": "x"}})
    a = pipeline.run(spark, path, workdir=str(tmp_path / "w"), schema=schema, analysis=ANALYSIS)
    b = pipeline.run(spark, put(tmp_path / "o.csv", CLEAN), workdir=str(tmp_path / "w"), schema=target, analysis=ANALYSIS)
    assert a["results_sha256"] == b["results_sha256"]
    assert mapping.schema_fit([target, schema], info.columns)[0]["matched"] == 6
    with pytest.raises(MappingError):
        mapping.parse_reply('{"mappings": [{"source": "a", "target": "b", "confidence": 2}]}')
    with pytest.raises(MappingError):
        mapping.egress_mode(get_policy("regulated"), False)


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "b.csv")
    assert cli.main(["sample", out, "--rows", "50", "--bad-percent", "20"]) == 0
    assert cli.main(["run", out, "--workdir", str(tmp_path / "w"), "--policy", "low"], spark) == 0
    assert cli.main(["run", out, "--workdir", str(tmp_path / "w")], spark) == 1  # the tier is business unless named
    assert "COMPLETED" in capsys.readouterr().out
    assert cli.main(["infer", out], spark) == 0
    assert cli.main(["verify-audit", "--workdir", str(tmp_path / "w")]) == 0
    assert cli.main(["policies"]) == 0
    with pytest.raises(SystemExit) as e:
        cli.main(["unknown"])
    assert e.value.code == 64
    assert generate_buyers(str(tmp_path / "c.csv"), 10, seed=1) == 10


def test_inbox_stream(spark, tmp_path):
    from quarrymill.streaming import inbox

    box, out = tmp_path / "box", tmp_path / "out"
    box.mkdir()
    (box / "a.jsonl").write_text('{"a": "1"}\n{"a": "x"}\nbroken\n')
    schema = schema_from_dict({"columns": [{"name": "a", "type": "integer"}]})
    for _ in range(2):
        raw = inbox.json_inbox(spark, str(box), schema)
        inbox.ingest(raw, schema, get_policy("low"), str(out), str(tmp_path / "cp")).awaitTermination()
        (box / "b.jsonl").write_text('{"a": "2"}\n')
    assert sorted(r.a for r in spark.read.parquet(str(out / "valid")).collect()) == [1, 2]
    assert spark.read.parquet(str(out / "quarantine")).count() == 2


def test_dumps_as_the_shell_writes_them(spark, tmp_path):
    body = """PRAGMA foreign_keys=OFF;
BEGIN TRANSACTION;
DROP TABLE IF EXISTS t;
CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT);
SAVEPOINT a;
INSERT INTO t VALUES(1,'x');
DELETE FROM sqlite_sequence;
INSERT INTO sqlite_sequence VALUES('t',1);
RELEASE a;
COMMIT;
"""
    (tmp_path / "d.sql").write_text(body)
    raw, _ = read_source(spark, str(tmp_path / "d.sql"))
    assert [(r.id, r.v) for r in raw.collect()] == [("1", "x")]
    for bad in ("ATTACH DATABASE '/tmp/x.db' AS x;", "PRAGMA writable_schema=1;", "CREATE TABLE t (a); INSERT INTO t VALUES (readfile('/etc/passwd'));"):
        (tmp_path / "bad.sql").write_text(bad)
        with pytest.raises(SourceError):
            read_source(spark, str(tmp_path / "bad.sql"))


def test_lines_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"a": "grün"}\n{"a": "1e999999999"}\n{"a": 1e999999999}\n'.encode("latin-1"))
    raw, _ = read_source(spark, str(tmp_path / "a.jsonl"), encoding="latin-1")
    assert [r.a for r in raw.orderBy("_row").collect()] == ["grün", "1e999999999", "1E+999999999"]
    with pytest.raises(SourceError):
        read_source(spark, str(tmp_path / "a.jsonl"))
    (tmp_path / "b.jsonl").write_text('\ufeff{"a": "\ufffd"}\n', encoding="utf-8")
    assert [r.a for r in read_source(spark, str(tmp_path / "b.jsonl"))[0].collect()] == ["\ufffd"]


def test_personal_names_of_columns():
    from quarrymill.operators.infer import PII_HINT

    assert all(PII_HINT.search(n) for n in ("name", "customer name", "dob", "salary", "card_no", "E-Mail", "Mobile", "street"))
    assert not any(PII_HINT.search(n) for n in ("region", "amount", "order_date", "paid", "notes"))


def test_pairs_are_judged_by_all_columns(spark):
    raw = spark.createDataFrame([(k, None, str(k), str(k * 2), "x", None) for k in range(1, 9)], "_row bigint, _problem string, `Order No` string, weight string, text string, nothing string")
    target = schema_from_dict({"columns": [{"name": "order_id", "type": "integer", "unique": True}, {"name": "depth", "type": "integer"}, {"name": "note", "type": "string"}]})
    ask = lambda *pairs: mapping.verify_items(raw, target, [{"source": s, "target": t, "confidence": c, "reason": ""} for s, t, c in pairs])
    got = ask(("weight", "depth", 0.9), ("Order No", "order_id", 0.95), ("text", "depth", 0.99), ("Order No", "note", 0.94), ("zzz", "note", 1.0), ("nothing", "note", 0.85))
    assert [(m["source"], m["target"], m["verdict"]) for m in got] == [
        ("zzz", "note", "rejected"), ("text", "depth", "rejected"), ("Order No", "order_id", "accepted"), ("Order No", "note", "rejected"),
        ("weight", "depth", "needs_review"), ("nothing", "note", "needs_review"),
    ]
    assert got[4]["evidence"]["alternatives"] == ["Order No"]
    with pytest.raises(MappingError):
        mapping.verify_manual(raw, target, "nothing", "note")
    assert mapping.verify_manual(raw, target, "weight", "depth")["notes"] == ["the names differ"]
    assert mapping.Heuristic().propose({"columns": [], "target": []}) == []


def test_report_prints_every_row():
    from quarrymill.plans import outputs

    doc = {"run_id": "r", "status": "COMPLETED", "policy": "low", "input": "x", "results": {"metrics": {"m": {"description": "", "columns": ["a"], "rows": [[k] for k in range(120)]}}}}
    assert outputs.report(doc).count("\n| ") == 120 + 3
