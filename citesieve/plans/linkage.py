"""Queries of the full-text handoff and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesieve.operators import linkage as k
from citesieve.plans import fixtures as fx
from citesieve.plans.panel import PANEL, papers, reviews
from citesieve.plans.register import registry
from citesieve.operators.panel import resolve_reviews
from citesieve.sources import sinks

QUERIES, ORACLES, register = registry()


def handoff(spark, sf):
    """Recovery list of the papers, some of them under a panel and some with a human label."""
    resolved = resolve_reviews(papers(spark, sf), reviews(spark, sf)).withColumn(
        "consensus_status", F.when(F.col("consensus_status") != "awaiting_second_reviewer", F.col("consensus_status")))
    labelled = resolved.join(fx.human_labels(spark, sf), "doc_id", "left")
    return k.recovery_list(labelled.withColumn("extra", F.create_map(F.lit("JOURNAL"), F.col("lang"))))


SQL_HANDOFF = """effective AS (
  SELECT p.*, r.status, h.human_decision, abstract = '' AS missing, status NOT IN ('awaiting_second_reviewer') AS panel,
         CASE WHEN status <> 'awaiting_second_reviewer' THEN CASE status WHEN 'agreed' THEN second WHEN 'adjudicated' THEN judge END
              WHEN h.human_decision IS NOT NULL THEN h.human_decision ELSE r.first END AS eff
  FROM papers p JOIN resolved r ON p."row" = r."row" LEFT JOIN human h ON p.doc_id = h.doc_id),
handoff AS (
  SELECT 'sr-b0-r' || "row" AS record_id, trim(title) AS title, doi, lang AS journal, eff AS decision,
         CASE WHEN panel THEN 'panel' WHEN human_decision IS NOT NULL THEN 'human' ELSE 'screening' END AS decision_source,
         CASE WHEN eff = 'Include' THEN 'advance_to_full_text' WHEN eff = 'Likely include' THEN 'confirm_inclusion_gaps'
              WHEN missing THEN 'resolve_missing_abstract' ELSE 'resolve_uncertainty' END AS recovery_reason,
         'sr-b0-r' || "row" || '.pdf' AS pdf_filename
  FROM effective WHERE (NOT panel OR coalesce(eff IN ('Include', 'Exclude'), false) OR missing) AND eff IS DISTINCT FROM 'Exclude'
    AND (coalesce(eff IN ('Include', 'Likely include', 'Maybe'), false) OR missing))"""


@register("recovery_list", fx.sql(*PANEL, fx.SQL_LABELLED, SQL_HANDOFF, select="SELECT * FROM handoff"))
def recovery(spark, sf):
    return handoff(spark, sf).select("record_id", "title", "doi", "journal", "decision", "decision_source", "recovery_reason", "pdf_filename")


@register("write_recovery", fx.sql(*PANEL, fx.SQL_LABELLED, SQL_HANDOFF, select="""
SELECT record_id, CASE WHEN regexp_matches(title, '^\\s*[=+@-]') THEN '''' || title ELSE title END AS title, '' AS authors, '' AS year, doi, journal,
       '' AS url, '' AS source_id, coalesce(decision, '') AS decision, decision_source, recovery_reason, pdf_filename, 'missing' AS file_status FROM handoff"""))
def recovery_table(spark, sf):
    return sinks.recovery_table(handoff(spark, sf).withColumn("file_status", F.lit("missing")))


@register("duplicate_rows", """
SELECT 'b0' AS batch_id, user_id AS "row", count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1 OR user_id < 1""")
def duplicates(spark, sf):
    return k.duplicate_rows(fx.label_events(spark, sf))


SQL_MATCH = r"""lib AS (
  SELECT doc_id, "row" AS library_row, CASE WHEN doc_id % 9 = 8 THEN '' ELSE '  ' || replace(title, '.', ' !') END AS title,
         CASE WHEN doc_id % 9 < 3 THEN '10.5555/' || doc_id WHEN doc_id % 9 IN (3, 4, 5, 8) THEN '' WHEN doc_id % 9 = 6 THEN '10.5555/' || (doc_id + 1)
              ELSE '10.9/none' END AS doi_key FROM papers),
lk AS (SELECT *, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS title_key FROM lib),
pk AS (SELECT "row", title, doi AS doi_key, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS title_key FROM papers),
pd AS (SELECT doi_key, count(*) AS n, min("row") AS r, min(title_key) AS tk FROM pk GROUP BY 1),
pt AS (SELECT title_key, count(*) AS n, min("row") AS r, min(doi_key) AS dk FROM pk WHERE title_key <> '' GROUP BY 1),
matched AS (
  SELECT l.*, d.n AS dn, t.n AS tn, d.r AS dr, t.r AS tr, d.tk, t.dk,
         CASE WHEN d.n IS NOT NULL THEN 'doi' WHEN t.n IS NOT NULL THEN 'title' END AS match_method, coalesce(d.n, t.n, 0) AS n_candidates,
         CASE WHEN coalesce(d.n, t.n) = 1 THEN coalesce(d.r, t.r) END AS candidate_row
  FROM lk l LEFT JOIN pd d ON l.doi_key <> '' AND l.doi_key = d.doi_key LEFT JOIN pt t ON d.n IS NULL AND l.title_key <> '' AND l.title_key = t.title_key),
linked AS (
  SELECT *, CASE WHEN n_candidates = 0 THEN 'unmatched' WHEN n_candidates > 1 THEN 'ambiguous'
     WHEN match_method = 'title' AND doi_key <> '' AND doi_key <> dk THEN 'metadata_conflict'
     WHEN match_method = 'doi' AND title_key <> '' AND title_key <> tk THEN 'metadata_conflict' ELSE 'proposed' END AS match_status FROM matched)"""


@register("match_library", fx.sql(fx.SQL_PAPERS, SQL_MATCH, select="""
SELECT library_row, match_method, n_candidates, coalesce(candidate_row, -1) AS candidate_row FROM linked"""))
def match(spark, sf):
    return k.match_library(fx.library(spark, sf), fx.papers(spark, sf)).select(
        "library_row", "match_method", "n_candidates", F.coalesce("candidate.row", F.lit(-1)).alias("candidate_row"))


@register("match_status", fx.sql(fx.SQL_PAPERS, SQL_MATCH, select="""
SELECT match_status, match_method, count(*) AS n FROM linked GROUP BY ALL"""))
def status(spark, sf):
    return k.match_library(fx.library(spark, sf), fx.papers(spark, sf)).groupBy("match_status", "match_method").agg(
        F.count(F.lit(1)).alias("n"))


@register("match_candidates", fx.sql(fx.SQL_PAPERS, SQL_MATCH, select="""
SELECT 'title' AS match_method, title_key AS match_key, "row" FROM pk
WHERE title_key IN (SELECT title_key FROM linked WHERE match_status = 'ambiguous' AND match_method = 'title')"""))
def candidates(spark, sf):
    matches = k.match_library(fx.library(spark, sf), fx.papers(spark, sf))
    return k.match_candidates(matches, fx.papers(spark, sf)).select("match_method", "match_key", "row")


def inventory(spark, sf):
    """Files derived from the documents: some missing, some with a fault, some changed since."""
    turn = F.col("doc_id") % 7
    return fx.table(spark, sf, "documents").select(
        F.concat(F.when(turn == 6, "moved/").otherwise("in/"), "doc_id", F.lit(".pdf")).alias("filename"), F.sha2("text", 256).alias("sha256"),
        F.when(turn == 5, "invalid_signature").alias("file_error"))


SQL_FILES = """files AS (
  SELECT CASE WHEN doc_id % 7 <> 6 THEN doc_id END AS doc_id, doc_id || '.pdf' AS filename, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 5 THEN 'invalid_signature' END AS file_error
  FROM documents)"""


@register("import_preview", fx.sql(fx.SQL_PAPERS, SQL_MATCH, SQL_FILES, select="""
SELECT library_row, match_status, f.sha256, CASE WHEN f.filename IS NULL THEN 'not_found' ELSE file_error END AS file_error
FROM linked l LEFT JOIN files f USING (doc_id)"""))
def preview(spark, sf):
    return k.import_preview(fx.library(spark, sf), fx.papers(spark, sf), inventory(spark, sf)).select(
        "library_row", "match_status", "sha256", "file_error")


@register("file_status", fx.sql(fx.SQL_PAPERS, SQL_FILES, select="""
SELECT "row", CASE WHEN filename IS NULL THEN 'missing' WHEN file_error IS NOT NULL THEN 'invalid_signature' ELSE 'present' END AS file_status
FROM papers LEFT JOIN files USING (doc_id)"""))
def files(spark, sf):
    listed = fx.papers(spark, sf).select("row", F.concat(F.lit("in/"), "doc_id", F.lit(".pdf")).alias("pdf_filename"))
    return k.file_status(listed, inventory(spark, sf)).select("row", "file_status")


def link_requests(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("library_row"), F.lit("b0").alias("batch_id"), (F.col("user_id") + F.col("event_id") % 3 % 2).alias("row"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")


SQL_LINKS = SQL_FILES + """,
asked AS (SELECT event_id, ts, user_id AS library_row, user_id + event_id % 3 % 2 AS "row" FROM events),
judged AS (
  SELECT a.*, CASE WHEN l.library_row IS NULL OR p."row" IS NULL THEN 'unknown_record_or_target' WHEN f.filename IS NULL OR f.file_error IS NOT NULL THEN 'file_unusable'
                   WHEN l.library_row % 5 = 0 THEN 'file_changed' END AS reject_reason,
         CASE WHEN l.match_status = 'proposed' AND l.candidate_row = a."row" THEN l.match_method ELSE 'manual' END AS match_method
  FROM asked a LEFT JOIN linked l USING (library_row) LEFT JOIN papers p ON a."row" = p."row" LEFT JOIN files f ON l.doc_id = f.doc_id)"""


def confirmed(spark, sf):
    seen = k.import_preview(fx.library(spark, sf), fx.papers(spark, sf), inventory(spark, sf))
    seen = seen.withColumn("sha256", F.when(F.col("library_row") % 5 == 0, F.lit("changed")).otherwise(F.col("sha256")))
    targets = fx.papers(spark, sf).select(
        F.lit("b0").alias("batch_id"), "row", F.concat(F.lit("sr-b0-r"), "row").alias("record_id"),
        F.concat(F.lit("sr-b0-r"), "row", F.lit(".pdf")).alias("pdf_filename"))
    return k.confirm_links(link_requests(spark, sf), seen, inventory(spark, sf), targets)


@register("confirm_links", fx.sql(fx.SQL_PAPERS, SQL_MATCH, SQL_LINKS, select="""
SELECT event_id, library_row, "row", match_method FROM judged WHERE reject_reason IS NULL"""))
def confirm(spark, sf):
    return confirmed(spark, sf)[0].select("event_id", "library_row", "row", "match_method")


@register("refused_links", fx.sql(fx.SQL_PAPERS, SQL_MATCH, SQL_LINKS, select="""
SELECT event_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL"""))
def refused(spark, sf):
    return confirmed(spark, sf)[1].select("event_id", "reject_reason")


@register("latest_links", fx.sql(fx.SQL_PAPERS, SQL_MATCH, SQL_LINKS, select="""
SELECT "row", library_row, match_method FROM judged WHERE reject_reason IS NULL
QUALIFY row_number() OVER (PARTITION BY "row" ORDER BY ts DESC, event_id DESC) = 1"""))
def links(spark, sf):
    return k.latest_links(confirmed(spark, sf)[0]).select("row", "library_row", "match_method")
