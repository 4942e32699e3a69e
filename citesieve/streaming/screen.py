"""Arriving citations screened once each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.operators.screening import KEYS, screen_classifier
from citesieve.streaming.labels import run_name


def finished(spark: SparkSession, target: str, fingerprint: str, run: str, epoch: int) -> DataFrame | None:
    """Keys that ``target`` holds under ``fingerprint``, but for those of the given epoch; None before the first result."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    try:
        table = spark.read.parquet(target)
    except AnalysisException:  # only batches without rows so far
        return None
    kept = table.where((F.col("fingerprint") == fingerprint) & ~((F.col("run") == run) & (F.col("epoch") == epoch)))
    return kept.select(*[F.col(k) for k in KEYS]).distinct()


def stream_screen(citations: DataFrame, criteria: list[dict], scorer, target: str, checkpoint: str, fingerprint: str,
                  trigger: dict | None = None, **options):
    """Append results of a citation stream to ``target``, partitioned by batch.

    The stream keeps no state. A micro-batch leaves out citations that ``target`` has under the same
    fingerprint, then screens the rest; one that runs again after a failure replaces the output of
    its own epoch. Runs are named by their checkpoint, so every citation is in the results once,
    also when a stream starts over with a new checkpoint.
    """
    run = run_name(checkpoint)

    def save(batch: DataFrame, epoch: int) -> None:
        done = finished(batch.sparkSession, target, fingerprint, run, epoch)
        rest = batch.join(done, KEYS, "left_anti") if done is not None else batch
        results = screen_classifier(rest, criteria, scorer, **options).withColumn("fingerprint", F.lit(fingerprint))
        results.write.mode("overwrite").partitionBy("batch_id").parquet(f"{target}/run={run}/epoch={epoch}")

    return (citations.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
