"""A folder of arriving record files as a stream: each trigger loads what is new, checks it and appends both outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.model import ROW, Policy, Schema
from quarrymill.operators import validate
from quarrymill.operators.validate import PROBLEM


def json_inbox(spark: SparkSession, folder: str, schema: Schema, files_per_trigger: int = 100) -> DataFrame:
    """Raw rows of JSON Lines files in a folder; a line that does not parse is kept with its problem."""
    fields = ", ".join(f"`{c.src}` string" for c in schema.columns)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = F.from_json("value", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.length(F.trim("value")) > 0).select(
        F.xxhash64("value", F.input_file_name()).alias(ROW),
        F.when(parsed.isNull() | parsed["_bad"].isNotNull(), "the line is not strict JSON").alias(PROBLEM),
        *(parsed[c.src].alias(c.src) for c in schema.columns),
    )


def ingest(raw: DataFrame, schema: Schema, policy: Policy, out: str, checkpoint: str):
    """Runs over everything that has arrived and stops. Valid and quarantined rows are appended to two Parquet folders."""

    def batch(df: DataFrame, number: int) -> None:
        checked = validate.validate(df, schema, policy).persist()
        try:
            good = validate.valid(checked).select(ROW, *(c.name for c in schema.columns)).withColumn("batch", F.lit(number))
            bad = validate.quarantined(checked).select(ROW, "_issues").withColumn("batch", F.lit(number))
            # a batch that is run again after a failure replaces its own folder
            good.drop("batch").write.mode("overwrite").parquet(f"{out}/valid/batch={number}")
            bad.drop("batch").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        finally:
            checked.unpersist()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """Events per day and kind; on a stream, days close once the watermark has passed them."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n_events")).select(F.to_date("w.start").alias("day"), kind, "n_events")
