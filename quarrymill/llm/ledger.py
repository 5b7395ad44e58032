"""Duplicates hidden by formatting: an incremental ledger of canonical keys in buckets.

A record's canonical key is the digest of its six labelled fields, each reduced to its letters and digits in
lower case, in a fixed field order. The ledger lies in a folder that can be opened again by any later session: segments, each a table bucketed
by that key with the number of copies and the smallest row number seen, and a manifest that names them. A batch is aggregated (partially on the
map side, so a group of copies that holds a third of the rows leaves one row per task) and written as a segment of its own, so adding
costs what the batch costs, not what the ledger holds. A segment that is not much larger than the one after it is merged with it: a full outer
join of matching buckets, without a shuffle, adds the counts and keeps the earliest representative. So a key is rewritten
as often as the ledger has grown fourfold. A manifest is written whole and renamed before segments that it no longer names are removed: a job that
fails in between leaves the ledger as it was before or after.

Copies are told apart from their keeper by a join of the keyed rows with ledger entries of two or more. Keys
with more than a thousandth of all rows (hence at most 1000) are salted on both sides.

Defined results: a null or empty record, or one without any of the labels, has six empty fields and such
records are copies of each other; an absent field equals an empty one and a null one; a label given twice
counts twice; ties do not arise as the keeper is the smallest row number; rows with a null row number are counted but
never become a copy_row; an empty table gives empty results; other columns may have any name.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import scratch_path

FIELDS = ("orderid", "customeremail", "region", "amount", "orderdate", "paid")
_LABELS = r"order[\s_.\-]*id|customer[\s_.\-]*email|region|amount|order[\s_.\-]*date|paid"
_BREAK = rf"(?i)[;|\t]\s*(?=[\[({{<\"']*(?:{_LABELS})[\"']?\s*[=:])"
HOT_SHARE = 1000
SALTS = 32


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def canonical_text(record: Column) -> Column:
    """The six fields of a record, reduced and in order of their labels; empty fields are left out."""
    text = F.coalesce(record, F.lit(""))
    parsed = F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    from_json = F.transform(
        F.map_entries(parsed),
        lambda e: F.struct(_plain(e["key"]).alias("label"), _plain(F.coalesce(e["value"], F.lit(""))).alias("value")),
    )
    from_pairs = F.transform(
        F.split(text, _BREAK),
        lambda p: F.struct(
            _plain(F.regexp_extract(p, r"^([^=:]*)[=:]", 1)).alias("label"),
            _plain(F.regexp_extract(p, r"(?s)^[^=:]*[=:](.*)$", 1)).alias("value"),
        ),
    )
    fields = F.filter(F.coalesce(from_json, from_pairs), lambda e: e["label"].isin(*FIELDS) & (e["value"] != ""))
    return F.array_join(F.array_sort(F.transform(fields, lambda e: F.concat(e["label"], F.lit("="), e["value"]))), ";")


def keyed(df: DataFrame, row: str, record: str, order: str | None = None) -> DataFrame:
    """(row_id, seen_at, key) of every row."""
    return df.select(
        F.col(row).cast("bigint").alias("row_id"),
        (F.col(order) if order else F.lit(None)).cast("timestamp_ntz").alias("seen_at"),
        F.unhex(F.sha2(canonical_text(F.col(record)), 256)).alias("key"),
    )


#: A segment is merged with the next one unless it is more than so many times larger.
GROWTH = 4


class Ledger:
    """Canonical keys with their counts: segments of buckets in a folder."""

    def __init__(self, spark, path: str, buckets: int, segments: list[dict], version: int):
        self.spark, self.path, self.buckets, self.segments, self.version = spark, path, buckets, segments, version
        self._tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark, path: str | None = None, buckets: int | None = None) -> Ledger:
        """The ledger in a folder (a new one if there is none yet); the number of buckets is settled by its first batch."""
        path = path or scratch_path(spark, "ledger")
        fs, at = cls._fs(spark, path)
        found = []
        if fs.exists(at):
            names = [s.getPath().getName() for s in fs.listStatus(at)]
            found = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not found:
            return cls(spark, path, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [], 0)
        doc = json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/manifest-{found[-1]}.json").collect()))
        return cls(spark, path, doc["buckets"], doc["segments"], found[-1])

    @staticmethod
    def _fs(spark, path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at

    def _table(self, segment: dict) -> DataFrame:
        """A segment as a bucketed table of this session's catalogue."""
        name = self._tables.get(segment["name"])
        if name is None:
            name = self._tables[segment["name"]] = f"ledger_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {name} (key BINARY, copies BIGINT, keep_row BIGINT) USING parquet CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{segment['name']}'"
            )
        return self.spark.table(name)

    def entries(self) -> DataFrame:
        if not self.segments:
            return self.spark.createDataFrame([], "key binary, copies bigint, keep_row bigint")
        return reduce(self._merged, map(self._table, self.segments))

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({"copies": "n", "keep_row": "first"})
        copies = F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))
        return a.join(b, "key", "full_outer").select("key", copies.alias("copies"), F.least("keep_row", "first").alias("keep_row"))

    def _write(self, rows: DataFrame) -> dict:
        segment = {"name": f"segment-{uuid.uuid4().hex}"}
        name = self._tables[segment["name"]] = f"ledger_{uuid.uuid4().hex}"
        rows.write.option("path", f"{self.path}/{segment['name']}").bucketBy(self.buckets, "key").saveAsTable(name)
        return segment | {"rows": self.spark.table(name).count()}

    def _commit(self, segments: list[dict]) -> None:
        fs, _ = self._fs(self.spark, self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        version = self.version + 1
        temp, final = path(f"{self.path}/.manifest-{version}-{uuid.uuid4().hex}"), path(f"{self.path}/manifest-{version}.json")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "segments": segments}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError("another job has added to the ledger meanwhile")
        gone = [s for s in self.segments if s not in segments]
        self.segments, self.version = segments, version
        fs.delete(path(f"{self.path}/manifest-{version - 1}.json"), False)
        for s in gone:
            self._remove(s)

    def _remove(self, segment: dict) -> None:
        if name := self._tables.pop(segment["name"], None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, _ = self._fs(self.spark, self.path)
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{segment['name']}"), True)

    def add(self, batch: DataFrame) -> None:
        """Aggregate the batch's keys, write them as a segment, and merge it with those that have become alike in size."""
        new = (
            batch.groupBy("key", F.spark_partition_id().alias("part"))
            .agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
            .drop("part")
            .repartition(self.buckets, "key")
            .groupBy("key")
            .agg(F.sum("n").alias("copies"), F.min("first").alias("keep_row"))
        )
        segments = [*self.segments, self._write(new)]
        while len(segments) > 1 and segments[-2]["rows"] <= GROWTH * segments[-1]["rows"]:
            *rest, a, b = segments
            segments = [*rest, self._write(self._merged(self._table(a), self._table(b)))]
            for s in (a, b):
                if s not in self.segments:  # never named by a manifest
                    self._remove(s)
        self._commit(segments)


def build(df: DataFrame, row: str, record: str, order: str | None = None, batches: int = 3, folder: str | None = None) -> tuple[DataFrame, Ledger]:
    """The keyed rows (written once) and the ledger of them after ``batches`` batches in order of arrival, added to the ledger in ``folder`` if named."""
    spark = df.sparkSession
    path = scratch_path(spark, "keyed")
    keyed(df, row, record, order).write.parquet(path)
    rows = spark.read.schema("row_id bigint, seen_at timestamp_ntz, key binary").parquet(path)
    ledger = Ledger.open(spark, folder)
    low, high = rows.agg(
        F.min(F.unix_micros(F.col("seen_at").cast("timestamp"))), F.max(F.unix_micros(F.col("seen_at").cast("timestamp")))
    ).first()
    if low is None or batches < 2:
        ledger.add(rows)
        return rows, ledger
    step = (high - low) // batches + 1
    number = F.coalesce(F.floor((F.unix_micros(F.col("seen_at").cast("timestamp")) - F.lit(low)) / F.lit(step)), F.lit(0))
    for k in range(batches):
        ledger.add(rows.where(number == k))
    return rows, ledger


def copies(rows: DataFrame, ledger: Ledger) -> DataFrame:
    """(keep_row, copy_row): one row per member of a group of copies other than its keeper."""
    spark = ledger.spark
    entries = ledger.entries().where("copies > 1")
    total = ledger.entries().agg(F.sum("copies")).first()[0] or 0
    hot = [bytes(r[0]) for r in entries.where(F.col("copies") > max(10_000, total // HOT_SHARE)).select("key").collect()]
    if hot:  # at most HOT_SHARE keys, by the share that makes them hot
        is_hot = F.col("key").isin([F.lit(k) for k in hot])
        rows = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).otherwise(F.lit(0)))
        entries = entries.withColumn(
            "salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        ).withColumn("salt", F.col("salt").cast("bigint"))
        joined = rows.join(entries, ["key", "salt"])
    else:
        joined = rows.join(entries, "key")
    return joined.where(F.col("row_id") != F.col("keep_row")).select("keep_row", F.col("row_id").alias("copy_row"))


def folded(df: DataFrame, ledger: Ledger, row: str, record: str) -> DataFrame:
    """One record per group of copies with the number of its copies."""
    kept = ledger.entries().select(F.col("keep_row").alias("feed_row"), "copies")
    first = df.select(F.col(row).cast("bigint").alias("feed_row"), F.col(record).alias("record"))
    return first.join(kept, "feed_row")
