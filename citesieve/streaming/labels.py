"""Label and review events as a stream: the last event wins per key."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.operators.screening import KEYS


def fold_labels(events: DataFrame, keys: list[str] = KEYS, values: list[str] = ["decision"]) -> DataFrame:
    """Last values per key by (ts, event_id). The same code runs on a batch or a stream; late or repeated events lose."""
    last = F.max_by(F.struct(*values, "ts", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def run_name(checkpoint: str) -> str:
    """A short name of the stream run that keeps its state in ``checkpoint``."""
    return "r" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def stream_labels(events: DataFrame, target: str, checkpoint: str, keys: list[str] = KEYS, values: list[str] = ["decision"],
                  trigger: dict | None = None):
    """Keep the current labels of a stream of events in the table at ``target``.

    State is one row per key. Each micro-batch writes only the keys it changed, as a new version
    folder; :func:`current_labels` folds the versions, so a repeated micro-batch changes nothing. A
    run is named by its checkpoint, so a stream with a new one leaves the versions of others alone.
    """
    def upsert(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/run={run_name(checkpoint)}/epoch={epoch}")

    return (fold_labels(events, keys, values).writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def current_labels(spark: SparkSession, target: str, keys: list[str] = KEYS, values: list[str] = ["decision"]) -> DataFrame:
    return fold_labels(spark.read.parquet(target), keys, values)


def compact_labels(spark: SparkSession, target: str, compacted: str, keys: list[str] = KEYS, values: list[str] = ["decision"]) -> None:
    """Write the folded versions as one table, to be used as the start of a new target."""
    current_labels(spark, target, keys, values).write.mode("overwrite").parquet(compacted)
