"""Fingerprints and incremental recomputation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages in order, and the stage each one needs.
STAGES = {"parsed": "pdf", "index": "parsed", "evidence": "index", "extraction": "evidence", "full_extraction": "parsed"}


def settings_hash(settings) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces. Settings are configuration, hashed on the driver."""
    text = json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def fingerprint(stage: str, inputs: dict[str, Column], settings=None) -> Column:
    """Fingerprint of a stage for each row: stage name, input hashes by name, and settings."""
    named = F.to_json(F.struct(*[inputs[k].alias(k) for k in sorted(inputs)]))
    return F.sha2(F.concat_ws("\n", F.lit(stage), named, F.lit(settings_hash(settings))), 256)


def row_hash(columns: list[str]) -> Column:
    """Hash of a row's columns in name order; nulls keep their place."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def output_hash(df: DataFrame, key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """(key, output_hash): independent of row order, and cheap for a key of any size.

    Row hashes are split into numbers and summed (with the row count), which combines on the map
    side; no list of a key's rows is built.
    """
    used = columns or [c for c in df.columns if c != key]
    digest = row_hash(used)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(p).cast("string").alias(f"_p{i}") for i, p in enumerate(parts)])
    return sums.select(key, F.sha2(F.concat_ws("|", F.col("_n").cast("string"), *[f"_p{i}" for i in range(8)]), 256).alias("output_hash"))


def stage_status(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """(doc_id, has_pdf, has_parsed, has_index, ...): a stage counts only when its manifest matches and the stage before it counts.

    ``docs`` holds doc_id, has_pdf and for each stage the expected ``<stage>_fingerprint`` and actual
    ``<stage>_output`` hash; ``manifests`` is (doc_id, stage, fingerprint, output_hash).
    """
    stored = manifests.groupBy("doc_id").agg(*[
        F.max(F.when(F.col("stage") == s, F.struct("fingerprint", "output_hash"))).alias(f"_{s}") for s in STAGES])
    df = docs.join(stored, "doc_id", "left")
    for stage, before in STAGES.items():
        current = (F.col(f"_{stage}.fingerprint") == F.col(f"{stage}_fingerprint")) & (F.col(f"_{stage}.output_hash") == F.col(f"{stage}_output"))
        df = df.withColumn(f"has_{stage}", F.col(f"has_{before}") & F.coalesce(current, F.lit(False)))
    return df.select("doc_id", "has_pdf", *[f"has_{s}" for s in STAGES])


def stale_docs(status: DataFrame, stage: str, force: bool = False) -> DataFrame:
    """Documents that have a file and need the stage; all of them when forced."""
    need = F.lit(True) if force else ~F.col(f"has_{stage}")
    return status.filter(F.col("has_pdf") & need).select("doc_id")


def table_fingerprint(rows: list[dict]) -> str:
    """Fingerprint of a configuration table, whatever its row order."""
    return settings_hash(sorted(json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for r in rows))


def plan_is_current(plan: list[dict], fields: list[dict], saved: dict) -> bool:
    """The saved plan identity matches both the plan and the field table."""
    return (saved.get("plan_fingerprint") == table_fingerprint(plan) and saved.get("schema_fingerprint") == table_fingerprint(fields))


def plan_identity(plan: list[dict], fields: list[dict]) -> dict:
    return {"plan_fingerprint": table_fingerprint(plan), "schema_fingerprint": table_fingerprint(fields)}
