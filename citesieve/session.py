"""Session defaults and the helpers every operator module shares."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows dealt by doc_id stay where they are for joins on doc_id and more columns.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers are fed small Arrow batches: rows carry whole documents.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

CONFIG_ROWS = 2_000
# Rows of an Arrow batch of model requests, each of which can hold a whole document.
REQUEST_ROWS = 200


def get_spark(app: str = "citesieve", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the cluster names, so model calls are never repeated.

    ``spark.checkpoint.dir`` wins. Only a local session may go without one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster must name one; a local session gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = REQUEST_ROWS) -> Iterator[None]:
    """Jobs started inside feed Python workers ``rows`` rows at a time at most, so their memory does not grow with a task's rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def unsorted_buckets(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Rows written inside that are dealt by bucket are not sorted by bucket first: a sort would spill rows in full, long texts included."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(buckets))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def config_rows(df: DataFrame, max_rows: int = CONFIG_ROWS) -> list[dict]:
    """Bring a configuration-sized table (criteria, fields, plan) to the driver, or refuse."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"Configuration tables are limited to {max_rows} rows")
    return [row.asDict(recursive=True) for row in rows]


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small configuration table built inside the JVM (no Python worker, no RDD)."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1] for part in schema.split(",")]
    structs = [F.struct(*[F.lit(row.get(n)).cast(k).alias(n) for n, k in zip(names, kinds)]) for row in rows]
    one = spark.range(0, 1, 1, 1)
    if not structs:
        return spark.createDataFrame([], schema)
    return one.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def shared(df: DataFrame) -> DataFrame:
    """Keep a small aggregate that several branches of one plan read, so its inputs are scanned once.

    Blocks lost with an executor are recomputed from lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def compute_once(df: DataFrame, columns: dict) -> DataFrame:
    """Add or replace columns behind a one-row generator.

    The optimizer pushes a predicate on a derived column below the projection that derives it, and
    then evaluates (and expands) the derivation again in the filter. Long decision expressions are
    therefore produced by ``inline``, which predicates on its output do not cross. Predicates on
    the other columns still reach the scan.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return made.select(*[c for c in df.columns], *[c for c in columns if c not in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """Cut a source that arrives in fewer splits than there are cores, before heavy work per row.

    A file of one row group is one split and would keep all but one core idle. Sources with
    enough splits are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def literal_json(value, schema: str):
    """A configuration value (lists, dicts, text, numbers) as one literal column, folded to a constant by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)
