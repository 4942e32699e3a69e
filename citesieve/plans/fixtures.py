"""Inputs of the registered queries: the driver tables seen as papers, labels, events and library.

Each fixture exists twice, as a DataFrame and as the same expressions in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.session import spread


# Tables whose rows carry texts, pages or vectors, so that work per row outweighs a repartition.
HEAVY = {"documents", "pages", "embeddings"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in HEAVY else df


CRITERIA = [
    {"label": "Population", "type": "include", "explicit_evidence_required": False, "confidence_threshold": 0.6,
     "statement": "The paper concerns human participants."},
    {"label": "Intervention", "type": "include", "explicit_evidence_required": True, "confidence_threshold": 0.7,
     "statement": "The paper evaluates an intervention."},
    {"label": "Outcome", "type": "include", "explicit_evidence_required": False, "confidence_threshold": 0.5,
     "statement": "The paper reports a measured outcome."},
    {"label": "Not primary", "type": "exclude", "explicit_evidence_required": False, "confidence_threshold": 0.8,
     "statement": "The paper is a review or a comment."},
]

# Primes of the arithmetic scorer: (entailment, contradiction, neutral) as (doc factor, criterion factor).
SCORE_PRIMES = [(31, 17), (53, 29), (71, 43)]


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return as_papers(table(spark, sf, "documents"))


def as_papers(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("source").alias("batch_id"), (F.col("doc_id") + 1).alias("row"), "doc_id", "lang",
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("doc_id") % 20 == 0, "").otherwise(F.col("text")).alias("abstract"),
        F.concat(F.lit("10.5555/"), "doc_id").alias("doi"))


def fixture_scores(criterion: dict) -> Column:
    """Deterministic class scores of a paper for a criterion, from ``doc_id`` and the criterion position."""
    cubes = []
    for doc_factor, ord_factor in SCORE_PRIMES:
        base = (1 + (F.col("doc_id") * doc_factor + criterion["ord"] * ord_factor) % 97).cast("double")
        cubes.append(base * base * base)
    total = cubes[0] + cubes[1] + cubes[2]
    return F.array(*[x / total for x in cubes])


def human_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, human_decision, quality, toxic): quality 1 is Include, 0 is Exclude."""
    return table(spark, sf, "labels").select(
        "doc_id", "quality", "toxic", F.when(F.col("quality") == 1, "Include").otherwise("Exclude").alias("human_decision"))


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    """Label events: the user is the paper, the event type the decision, ``error`` clears it."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("b0").alias("batch_id"), F.col("user_id").alias("row"),
        F.when(kind == "view", "Include").when(kind == "click", "Exclude").when(kind == "signup", "Maybe")
        .when(kind == "purchase", "Likely include").alias("decision"))


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    """Panel review events: role by parity of the event, decision by event type."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("b0").alias("batch_id"), F.col("user_id").alias("row"),
        F.when(F.col("event_id") % 2 == 0, "second_reviewer").otherwise("judge").alias("role"),
        F.when(kind.isin("view", "purchase"), "Include").otherwise("Exclude").alias("decision"),
        F.when(kind == "error", "").otherwise(F.concat(F.lit("because "), kind)).alias("reason"),
        F.when(kind == "signup", "old").otherwise("run1").alias("fingerprint"))


def library(spark: SparkSession, sf: str) -> DataFrame:
    """Every paper again as a reference-manager row with altered DOI and title punctuation."""
    turn = F.col("doc_id") % 9
    return papers(spark, sf).select(
        "doc_id", F.col("row").alias("library_row"),
        F.when(turn == 8, "").otherwise(F.concat(F.lit("  "), F.replace("title", F.lit("."), F.lit(" !")))).alias("title"),
        F.when(turn.isin(0, 1, 2), F.concat(F.lit("HTTPS://DOI.ORG/"), "doi"))
        .when(turn.isin(3, 4, 5, 8), "").when(turn == 6, F.concat(F.lit("doi: 10.5555/"), F.col("doc_id") + 1))
        .otherwise("10.9/none").alias("doi"),
        F.concat(F.lit("in/"), "doc_id", F.lit(".pdf")).alias("pdf_path"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut at line breaks as ready chunks; the kind makes some chunks unfit for recall."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("section"), F.posexplode(F.split("text", "\n")).alias("chunk_ix", "text"))
    return docs.withColumn("kind", F.when(F.col("chunk_ix") % 11 == 10, "code").otherwise("paragraph"))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(field, query_ix, query, keywords): benchmark passages as the queries of four fields; all their longer words are one keyword list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("f"), F.col("item_id") % 4).alias("field"), F.col("item_id").alias("query_ix"),
        F.col("text").alias("query"), F.array(F.array_join(words, " ")).alias("keywords"))


# --- the same in SQL -------------------------------------------------------------------------

SQL_PAPERS = """papers AS (
  SELECT source AS batch_id, doc_id + 1 AS "row", doc_id, lang, split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 20 = 0 THEN '' ELSE text END AS abstract, '10.5555/' || doc_id AS doi
  FROM documents)"""

SQL_CRITERIA = "crit(ord, label, type, explicit, threshold, statement) AS (VALUES " + ", ".join(
    f"({i}, '{c['label']}', '{c['type']}', {str(c['explicit_evidence_required']).lower()}, "
    f"{c['confidence_threshold']}::DOUBLE, '{c['statement']}')" for i, c in enumerate(CRITERIA)) + ")"

SQL_SCORED = """cubed AS (
  SELECT p.*, c.*, (1 + (doc_id * 31 + ord * 17) % 97)::DOUBLE AS a, (1 + (doc_id * 53 + ord * 29) % 97)::DOUBLE AS b,
         (1 + (doc_id * 71 + ord * 43) % 97)::DOUBLE AS d
  FROM papers p CROSS JOIN crit c WHERE abstract <> ''),
scored AS (
  SELECT * EXCLUDE (a, b, d), a*a*a / (a*a*a + b*b*b + d*d*d) AS entailment, b*b*b / (a*a*a + b*b*b + d*d*d) AS contradiction,
         d*d*d / (a*a*a + b*b*b + d*d*d) AS neutral
  FROM cubed)"""

SQL_OUTCOME = """outcome0 AS (
  SELECT *, CASE WHEN entailment >= contradiction AND entailment >= neutral THEN 'entailment'
                 WHEN contradiction >= neutral THEN 'contradiction' ELSE 'neutral' END AS status,
         greatest(entailment, contradiction, neutral) AS confidence
  FROM scored),
outcome AS (
  SELECT *, CASE WHEN confidence < threshold THEN 'uncertain' WHEN status = 'entailment' THEN 'supported'
                 WHEN status = 'contradiction' THEN 'contradicted' ELSE 'not_established' END AS finding,
         CASE WHEN confidence < threshold THEN 'unresolved'
              WHEN status = 'neutral' THEN CASE WHEN type = 'include' AND explicit THEN 'failed' ELSE 'unresolved' END
              WHEN type = 'include' THEN CASE WHEN status = 'entailment' THEN 'passed' ELSE 'failed' END
              WHEN status = 'entailment' THEN 'hit' ELSE 'cleared' END AS criterion_decision,
         list_sort([entailment, contradiction, neutral], 'DESC') AS ranked
  FROM outcome0)"""

SQL_DECIDED = """decided0 AS (
  SELECT batch_id, "row", doc_id,
         bool_or(criterion_decision IN ('failed', 'hit')) AS failed,
         count(*) FILTER (type = 'include') AS n_inc, count(*) FILTER (criterion_decision = 'passed') AS n_passed,
         count(*) FILTER (type = 'exclude' AND criterion_decision <> 'cleared') AS n_open_exc,
         count(*) FILTER (criterion_decision = 'unresolved') AS n_unres,
         count(*) FILTER (criterion_decision = 'unresolved' AND finding = 'uncertain') AS n_unc,
         count(*) FILTER (criterion_decision = 'unresolved' AND finding <> 'not_established') AS n_hard,
         string_agg(label, ', ' ORDER BY type DESC, ord) FILTER (criterion_decision IN ('failed', 'hit')) AS failed_labels,
         string_agg(label, ', ' ORDER BY ord) FILTER (criterion_decision = 'unresolved') AS unres_labels,
         max(confidence) FILTER (criterion_decision IN ('failed', 'hit')) AS top_failed, min(confidence) AS low,
         min(ranked[1] - ranked[2]) FILTER (criterion_decision = 'unresolved' AND finding = 'uncertain') AS gap_unc,
         min(ranked[1] - ranked[2]) FILTER (criterion_decision = 'unresolved') AS gap_unres,
         min(ranked[1] - ranked[2]) FILTER (criterion_decision IN ('failed', 'hit')) AS gap_failed,
         min(ranked[1] - ranked[2]) AS gap_all
  FROM outcome GROUP BY ALL),
decided1 AS (
  SELECT *, CASE WHEN failed THEN 'Exclude' WHEN n_inc > 0 AND n_passed = n_inc AND n_open_exc = 0 THEN 'Include'
                 WHEN n_open_exc = 0 AND n_passed > 0 AND n_hard = 0 THEN 'Likely include' ELSE 'Maybe' END AS decision
  FROM decided0),
decided AS (
  SELECT batch_id, "row", doc_id, decision,
         CASE decision WHEN 'Exclude' THEN 'criterion_failed:' || failed_labels WHEN 'Include' THEN 'all_criteria_passed'
              ELSE 'unresolved_criteria:' || unres_labels END AS reason,
         CASE decision WHEN 'Exclude' THEN top_failed WHEN 'Include' THEN low END AS decision_confidence,
         CASE decision WHEN 'Maybe' THEN CASE WHEN n_unc > 0 THEN 'uncertain' ELSE 'missing_evidence' END
              WHEN 'Likely include' THEN 'confirm_inclusion_gaps' ELSE 'optional_check' END AS review_group,
         (CASE decision WHEN 'Maybe' THEN CASE WHEN n_unc > 0 THEN 0 ELSE 1 END WHEN 'Likely include' THEN 2 ELSE 3 END)::INT AS group_rank,
         (CASE decision WHEN 'Maybe' THEN n_unres ELSE 0 END)::INT AS blocking_count,
         CASE decision WHEN 'Maybe' THEN CASE WHEN n_unc > 0 THEN gap_unc ELSE gap_unres END WHEN 'Likely include' THEN gap_unres
              WHEN 'Exclude' THEN gap_failed ELSE gap_all END AS score_gap
  FROM decided1)"""

SQL_LABELLED = """human AS (
  SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 'Include' ELSE 'Exclude' END AS human_decision FROM labels)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


SCREENED = (SQL_PAPERS, SQL_CRITERIA, SQL_SCORED, SQL_OUTCOME, SQL_DECIDED)
