"""Stage tables of a document run, and the manifest that says which rows of them count.

Every run appends its rows with its own name and then, in one commit, the manifest rows that make
them current. A document's stage is done while its manifest names the fingerprint that its inputs and
settings now have; the output hash in the manifest is the next stage's input, so a change that
leaves a stage's output as it was stops there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.operators.calls import new_run
from citesieve.operators.provenance import output_hash, stage_status
from citesieve.session import cut_lineage, unsorted_buckets

MANIFEST = "doc_id bigint, fingerprint string, output_hash string, complete boolean, error string, run string, stage string"


class StageStore:
    """``folder`` holds a table per stage output and the manifest, all bucketed by doc_id.

    Steps inside a document read them without a shuffle (``spark.sql.requireAllClusterKeysForCoPartition``
    is off). Rows of a run that never reached the manifest (a driver that died) are not current and
    harm nothing. ``compact`` gathers the current rows of a table under one run. ``buckets`` should
    be a small multiple of the cores that read a stage; it is fixed when the folder is made.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self._open("manifest", MANIFEST)

    def _name(self, name: str) -> str:
        return f"stage_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}_{name}"

    def _open(self, name: str, schema: str) -> str:
        """The catalog name of a table, registered over its folder (a new session finds what earlier ones wrote)."""
        table = self._name(name)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY (doc_id) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return table

    def _append(self, name: str, rows: DataFrame, schema: str, shown: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Append ``rows``, one file a bucket at most; the commit makes them visible at once. ``shown`` makes the stored rows of dealt ones, which can be smaller."""
        table = self._open(name, schema)
        dealt = rows.repartition(self.buckets, "doc_id")
        with unsorted_buckets(self.spark, self.buckets):
            (shown(dealt) if shown else dealt).select(*self.spark.table(table).columns).write.insertInto(table)

    def history(self) -> DataFrame:
        """Every manifest row ever written: one per document, stage and time the stage was made for it."""
        return self.spark.table(self._open("manifest", MANIFEST))

    def manifest(self, stage: str | None = None) -> DataFrame:
        """The latest manifest row of each document and stage."""
        rows = self.history() if stage is None else self.history().where(F.col("stage") == stage)
        names = ["fingerprint", "output_hash", "complete", "error", "run"]
        return rows.groupBy("doc_id", "stage").agg(F.max_by(F.struct(*names), "run").alias("_m")).select("doc_id", "stage", "_m.*")

    def table(self, name: str, schema: str) -> DataFrame:
        """All stored rows of a table, current or not; none if nothing was stored."""
        return self.spark.table(self._open(name, f"{schema}, run string"))

    def current(self, stage: str, name: str, schema: str) -> DataFrame:
        """The rows of a stage's table that its manifest names."""
        return self.table(name, schema).join(self.manifest(stage).select("doc_id", "run"), ["doc_id", "run"], "left_semi").drop("run")

    def stale(self, stage: str, wanted: DataFrame, force: bool = False) -> DataFrame:
        """(doc_id, fingerprint) of ``wanted`` whose stage was not completed under that fingerprint."""
        if force:
            return wanted
        done = self.manifest(stage).where("complete").select("doc_id", "fingerprint")
        return wanted.join(done, ["doc_id", "fingerprint"], "left_anti")

    def advance(self, stage: str, wanted: DataFrame, build: Callable[[DataFrame], dict], hashed: str, force: bool = False,
                finished: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Make a stage for the documents of ``wanted`` (doc_id, fingerprint) that need it; whether any did.

        ``build`` gives tables by name for the stale documents, or rows and a function that makes the table of
        them once they are dealt; ``errors`` among them (doc_id, error), or a function that finds them in what was stored
        under ``hashed``, is kept in the manifest: such a document is done, and later stages leave it out. The output
        hash is that of table ``hashed``. ``finished`` turns its stored rows into (doc_id, complete);
        what is not complete is made again by the next run.
        """
        todo = cut_lineage(self.stale(stage, wanted, force))
        if todo.isEmpty():
            return False
        run, tables = new_run(), build(todo)
        errors = tables.pop("errors", None)
        for name, made in tables.items():
            rows, shown = made if isinstance(made, tuple) else (made, lambda dealt: dealt)
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown(rows).schema)
            self._append(name, rows, f"{kinds}, run string", lambda dealt: shown(dealt).withColumn("run", F.lit(run)))
        stored = self.spark.table(self._name(hashed)).where(F.col("run") == run).drop("run")
        errors = errors(stored) if callable(errors) else errors
        made = todo.join(output_hash(stored), "doc_id", "left")
        state = finished(stored) if finished else made.select("doc_id").distinct().withColumn("complete", F.lit(True))
        made = made.join(state, "doc_id", "left")
        faults = errors.groupBy("doc_id").agg(F.min("error").alias("error")) if errors is not None else made.select("doc_id", F.lit(None).cast("string").alias("error")).limit(0)
        made = made.join(faults, "doc_id", "left")
        nothing = F.lit("nothing")  # a stage without rows has an output too
        made = made.select("doc_id", "fingerprint", F.coalesce("output_hash", nothing).alias("output_hash"), F.coalesce("complete", F.lit(False)).alias("complete"), "error",
                    F.lit(run).alias("run"), F.lit(stage).alias("stage"))
        self._append("manifest", made, MANIFEST)
        return True

    def inputs(self, stage: str, docs: DataFrame) -> DataFrame:
        """(doc_id, output_hash) of the documents of ``docs`` for which a stage is complete and without error."""
        good = self.manifest(stage).where("complete AND error IS NULL").select("doc_id", "output_hash")
        return good.join(docs.select("doc_id"), "doc_id", "left_semi")

    def status(self, docs: DataFrame, expected: dict[str, DataFrame], outputs: dict[str, DataFrame]) -> DataFrame:
        """(doc_id, has_pdf, has_parsed, ...) of ``docs`` (doc_id, has_pdf), checked against stored rows.

        ``expected`` gives (doc_id, fingerprint) and ``outputs`` the current rows by stage. A stage
        counts only if its rows still have the hash that its manifest noted.
        """
        from citesieve.operators.provenance import STAGES

        for stage in STAGES:
            for name, rows in (("fingerprint", expected.get(stage)), ("output", output_hash(outputs[stage]) if stage in outputs else None)):
                column = f"{stage}_{name}"
                if rows is None:
                    docs = docs.withColumn(column, F.lit(None).cast("string"))
                else:
                    docs = docs.join(rows.toDF("doc_id", column), "doc_id", "left")
                    docs = docs.withColumn(column, F.coalesce(column, F.lit("nothing"))) if name == "output" else docs
        manifests = self.manifest().where("complete").select("doc_id", "stage", "fingerprint", "output_hash")
        return stage_status(docs, manifests)

    def compact(self, stage: str, tables: dict[str, str]) -> None:
        """Gather the current rows of a stage's tables (name to schema) under one run; the manifest moves over in one commit.

        Readers that began before see the older runs, whose files stay.
        """
        run, latest = new_run(), self.manifest(stage)
        for name, schema in tables.items():
            rows = cut_lineage(self.current(stage, name, schema).withColumn("run", F.lit(run)))
            self._append(name, rows, f"{schema}, run string")
        self._append("manifest", cut_lineage(latest.withColumn("run", F.lit(run))), MANIFEST)


def with_fingerprint(inputs: DataFrame, stage: str, settings, **columns: Column) -> DataFrame:
    """(doc_id, fingerprint) of a stage from input hashes by name and settings."""
    from citesieve.operators.provenance import fingerprint

    return inputs.select("doc_id", fingerprint(stage, columns, settings).alias("fingerprint"))
