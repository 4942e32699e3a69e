"""Streaming queries: each runs its stream to the end of the input and returns the table it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry
from citesieve.plans.review import ORACLES as REVIEW_ORACLES
from citesieve.plans.screening import ORACLES as SCREEN_ORACLES
from citesieve.session import shared_folder
from citesieve.streaming.labels import current_labels, stream_labels
from citesieve.streaming.screen import stream_screen

QUERIES, ORACLES, register = registry()


def work_folder(spark) -> str:
    """A fresh folder in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def stream(spark, sf, name):
    """A table as a stream of its files. A pattern fits a table that is one file and one that is a folder of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@register("stream_labels", REVIEW_ORACLES["latest_paper_labels"])
def labels(spark, sf):
    kind = F.col("event_type")
    events = stream(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("b0").alias("batch_id"), F.col("user_id").alias("row"),
        F.when(kind == "view", "Include").when(kind == "click", "Exclude").when(kind == "signup", "Maybe")
        .when(kind == "purchase", "Likely include").alias("decision"))
    folder = work_folder(spark)
    stream_labels(events, f"{folder}/labels", f"{folder}/checkpoint").awaitTermination()
    kept = current_labels(spark, f"{folder}/labels")
    at = F.when(F.col("decision").isNotNull(), F.unix_micros("ts"))
    return kept.select("batch_id", "row", F.col("decision").alias("human_decision"), F.coalesce(at, F.lit(-1)).alias("labelled_us"))


@register("stream_screen", SCREEN_ORACLES["screen_classifier"])
def screen(spark, sf):
    docs = stream(spark, sf, "documents")
    folder = work_folder(spark)
    stream_screen(fx.as_papers(docs), fx.CRITERIA, fx.fixture_scores, f"{folder}/results", f"{folder}/checkpoint", "run1").awaitTermination()
    return spark.read.parquet(f"{folder}/results").select(
        "batch_id", "row", "screening_status", "decision", "reason", "decision_confidence", "review_group", "group_rank", "blocking_count", "score_gap")


@register("stream_resume", fx.sql(f"screened AS ({SCREEN_ORACLES['screen_classifier']})",
                                  select="SELECT screening_status, count(*) AS n FROM screened GROUP BY screening_status"))
def resume(spark, sf):
    """A second run over the same checkpoint, and a third over a new one, screen nothing again and lose nothing."""
    folder = work_folder(spark)
    for checkpoint in ("first", "first", "second"):
        stream_screen(fx.as_papers(stream(spark, sf, "documents")), fx.CRITERIA, fx.fixture_scores, f"{folder}/results",
                      f"{folder}/{checkpoint}", "run1").awaitTermination()
    return spark.read.parquet(f"{folder}/results").groupBy("screening_status").agg(F.count(F.lit(1)).alias("n"))
