"""A hash-chained log: append under an exclusive lock, refuse a damaged log, verify the whole chain."""

from __future__ import annotations

import fcntl
import getpass
import hashlib
import json
import os
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.errors import AuditError
from quarrymill.plans.canon import canonical

START = "0" * 64


def default_actor() -> str:
    try:
        return getpass.getuser()
    except (KeyError, OSError):
        return "unknown"


def digest(record: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in record.items() if k != "hash"}).encode()).hexdigest()


class AuditLog:
    def __init__(self, path: str):
        self.path = path

    @contextmanager
    def _locked(self):
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "a+", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            yield f

    @staticmethod
    def _intact(text: str) -> tuple[list[dict], str | None]:
        """The records before the first damage, and what is wrong with the next one."""
        records: list[dict] = []
        for line in text.splitlines(keepends=True):
            n = len(records) + 1
            if not line.endswith("\n"):
                return records, f"record {n} is cut off"
            try:
                r = json.loads(line)
            except ValueError:
                return records, f"record {n} is not JSON"
            if not isinstance(r, dict) or (r.get("seq"), r.get("prev")) != (n, records[-1]["hash"] if records else START) or r.get("hash") != digest(r):
                return records, f"record {n} breaks the chain"
            records.append(r)
        return records, None

    def _parse(self, text: str) -> list[dict]:
        records, fault = self._intact(text)
        if fault:
            raise AuditError(fault)
        return records

    def append(
        self, event: str, run_id: str | None = None, data: dict | None = None, actor: str | None = None, guard: Callable[[list[dict]], None] | None = None
    ) -> dict:
        """Adds a record; ``guard`` sees all records under the lock and may refuse by raising."""
        with self._locked() as f:
            records = self._parse(f.read())
            if guard:
                guard(records)
            record = {
                "seq": len(records) + 1,
                "ts": datetime.now(UTC).isoformat(timespec="microseconds"),
                "event": event,
                "run_id": run_id,
                "actor": actor or default_actor(),
                "data": data or {},
                "prev": records[-1]["hash"] if records else START,
            }
            record["hash"] = digest(record)
            f.seek(0, os.SEEK_END)
            f.write(canonical(record) + "\n")
            f.flush()
            os.fsync(f.fileno())
            return record

    def records(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with self._locked() as f:
            return self._parse(f.read())

    def verify(self) -> tuple[bool, int, str]:
        """(whether the whole log is intact, records before the first damage, what was found)."""
        if not os.path.exists(self.path):
            return True, 0, "0 records, chain intact"
        with open(self.path, "rb") as f:
            data = f.read()
        try:
            text = data.decode()
        except UnicodeDecodeError as e:
            text = data[: e.start].decode()
            text = text[: text.rfind("\n") + 1]
            return False, len(self._intact(text)[0]), "the log is not UTF-8 text"
        records, fault = self._intact(text)
        return fault is None, len(records), fault or f"{len(records)} records, chain intact"

    def head(self) -> str:
        records = self.records()
        return records[-1]["hash"] if records else START


def chain_breaks(spark: SparkSession, path: str) -> DataFrame:
    """Records whose number or previous hash does not follow from the record before, read as a table."""
    # the chain is one sequence: records are compared with the one of the number before by a join, not in one task
    log = spark.read.schema("seq bigint, prev string, hash string, event string").json(path)
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected"))
    return (
        log.join(before, "seq", "left")
        .where(F.col("prev") != F.coalesce("expected", F.when(F.col("seq") == 1, START), F.lit("")))
        .select("seq", "event")
    )
