"""Session helpers: shared working folder and size-aware partition settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by the session.

    Only where neither the session nor its context names one (tests in local mode) a temporary folder is
    made and set, so that a cluster never falls back on a machine-local folder silently.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    current = sc.getCheckpointDir()
    if not named and current:
        return current.rsplit("/", 1)[0]
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        named = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
    if not current:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan behind ``df`` is computed once and stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small input with fewer splits than cores to all of them; larger inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < min(cores, 64) else df
