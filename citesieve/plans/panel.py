"""Queries of the review panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesieve.operators import panel as p
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry
from citesieve.plans.screening import screened

QUERIES, ORACLES, register = registry()


def papers(spark, sf):
    return screened(spark, sf).withColumn("batch_id", F.lit("b0"))


def reviews(spark, sf):
    return p.fold_review_events(fx.review_events(spark, sf))


SQL_EVENTS = """rev AS (
  SELECT event_id, ts, user_id AS "row", CASE WHEN event_id % 2 = 0 THEN 'second_reviewer' ELSE 'judge' END AS role,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'Include' ELSE 'Exclude' END AS decision,
         CASE WHEN event_type = 'error' THEN '' ELSE 'because ' || event_type END AS reason,
         CASE WHEN event_type = 'signup' THEN 'old' ELSE 'run1' END AS fingerprint FROM events),
sec AS (SELECT "row", arg_max(decision, struct_pack(ts, event_id)) AS d, max(struct_pack(ts, event_id)) AS at FROM rev WHERE role = 'second_reviewer' GROUP BY 1),
jud AS (SELECT "row", arg_max(decision, struct_pack(ts, event_id)) AS d, max(struct_pack(ts, event_id)) AS at FROM rev WHERE role = 'judge' GROUP BY 1),
folded AS (
  SELECT coalesce(s."row", j."row") AS "row", s.d AS second, CASE WHEN s.at IS NULL OR j.at > s.at THEN j.d END AS judge
  FROM sec s FULL JOIN jud j ON s."row" = j."row"),
resolved AS (
  SELECT p."row", d.decision AS first, f.second, f.judge,
         CASE WHEN abstract = '' THEN 'manual_full_text_required' WHEN f.second IS NULL THEN 'awaiting_second_reviewer'
              WHEN d.decision = f.second THEN 'agreed' WHEN f.judge IS NULL THEN 'awaiting_judge' ELSE 'adjudicated' END AS status
  FROM papers p LEFT JOIN decided d ON p."row" = d."row" LEFT JOIN folded f ON p."row" = f."row")"""

PANEL = (*fx.SCREENED, SQL_EVENTS)


@register("resolve_reviews", fx.sql(*PANEL, select="""
SELECT "row", status AS consensus_status, CASE status WHEN 'agreed' THEN second WHEN 'adjudicated' THEN judge END AS consensus_decision FROM resolved"""))
def resolve(spark, sf):
    return p.resolve_reviews(papers(spark, sf), reviews(spark, sf)).select("row", "consensus_status", "consensus_decision")


@register("fold_review_events", fx.sql(*PANEL, select='SELECT "row", second, judge FROM folded'))
def fold(spark, sf):
    return reviews(spark, sf).select("row", F.col("second_reviewer.decision").alias("second"), F.col("judge.decision").alias("judge"))


@register("review_history", fx.sql(*PANEL, """prior AS (
  SELECT a.event_id, a."row", a.role, (SELECT max(struct_pack(ts := b.ts, event_id := b.event_id, decision := b.decision)) FROM rev b
          WHERE b."row" = a."row" AND b.role = a.role AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS same,
         (SELECT max(struct_pack(ts := b.ts, event_id := b.event_id)) FROM rev b
          WHERE b."row" = a."row" AND b.role = 'second_reviewer' AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS sec FROM rev a)""", select="""
SELECT event_id, "row", role, CASE WHEN role = 'second_reviewer' OR sec IS NULL OR (same.ts, same.event_id) > (sec.ts, sec.event_id)
       THEN same.decision END AS previous_decision FROM prior"""))
def history(spark, sf):
    return p.review_history(fx.review_events(spark, sf)).select("event_id", "row", "role", "previous_decision")


@register("second_review_candidates", fx.sql(*PANEL, select="""
SELECT "row" FROM resolved WHERE status <> 'manual_full_text_required' AND second IS NULL"""))
def second_candidates(spark, sf):
    return p.second_review_candidates(papers(spark, sf), reviews(spark, sf)).select("row")


@register("judge_candidates", fx.sql(*PANEL, select="""
SELECT "row", status AS consensus_status FROM resolved WHERE status IN ('awaiting_judge', 'judge_failed')"""))
def candidates(spark, sf):
    waiting, _ = p.judge_candidates(papers(spark, sf), reviews(spark, sf))
    return waiting.select("row", "consensus_status")


@register("rejected_judge_requests", fx.sql(*PANEL, select="""
SELECT e."row", CASE WHEN r.status IS NULL THEN 'paper_not_found' ELSE 'not_awaiting_judge' END AS reject_reason
FROM (SELECT DISTINCT user_id * 3 AS "row" FROM events) e LEFT JOIN resolved r ON e."row" = r."row"
WHERE r.status IS NULL OR r.status NOT IN ('awaiting_judge', 'judge_failed')"""))
def rejected_requests(spark, sf):
    asked = fx.review_events(spark, sf).select("batch_id", (F.col("row") * 3).alias("row"))
    return p.judge_candidates(papers(spark, sf), reviews(spark, sf), asked)[1].select("row", "reject_reason")


@register("judge_payload")
def payload(spark, sf):
    return p.judge_payload(papers(spark, sf), reviews(spark, sf))


@register("check_review_events", fx.sql(*PANEL, """faults AS (
  SELECT v.*, d.decision AS first, CASE WHEN fingerprint <> 'run1' THEN 'wrong_fingerprint' WHEN role = 'judge' AND v.reason = '' THEN 'judge_needs_reason'
           WHEN p."row" IS NULL THEN 'paper_not_found' WHEN p.abstract = '' THEN 'not_ready' END AS fault
  FROM rev v LEFT JOIN papers p ON v."row" = p."row" LEFT JOIN decided d ON v."row" = d."row"),
stated AS (
  SELECT *, last_value(CASE WHEN fault IS NULL AND role = 'second_reviewer' THEN decision END IGNORE NULLS)
    OVER (PARTITION BY "row" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS second FROM faults)""", select="""
SELECT event_id, coalesce(fault, CASE WHEN role = 'judge' AND (second IS NULL OR second = first) THEN 'not_ready' END) AS reject_reason FROM stated"""))
def checked(spark, sf):
    return p.check_review_events(fx.review_events(spark, sf), papers(spark, sf), "run1").select("event_id", "reject_reason")


@register("panel_consensus", fx.sql(*PANEL, select="""
SELECT status, CASE status WHEN 'agreed' THEN second WHEN 'adjudicated' THEN judge END AS decision, 'human' AS judge_kind, count(*) AS papers
FROM resolved GROUP BY ALL"""))
def consensus(spark, sf):
    out = p.consensus(papers(spark, sf), reviews(spark, sf), "run1", {"second_reviewer": "llm", "judge": "human"})
    return out.groupBy("consensus.status", "consensus.decision", F.col("consensus.roles.judge").alias("judge_kind")).agg(
        F.count(F.lit(1)).alias("papers"))


@register("panel_version", fx.sql(*PANEL, select="""
SELECT fingerprint = 'run1' AS is_current, role, count(*) AS n FROM rev GROUP BY ALL"""))
def version(spark, sf):
    current, archived = p.panel_version(fx.review_events(spark, sf), "run1")
    both = current.withColumn("is_current", F.lit(True)).unionByName(archived.withColumn("is_current", F.lit(False)))
    return both.groupBy("is_current", "role").agg(F.count(F.lit(1)).alias("n"))


@register("normalize_assessments", fx.sql(*PANEL, select="""
SELECT event_id, role, 'human' AS kind, decision, nullif(reason, '') AS reason, 'screened' AS screening_status FROM rev WHERE role = 'judge'
UNION ALL SELECT doc_id, 'primary', 'llm', decision, CASE WHEN reason <> 'all_criteria_passed' THEN reason END, 'screened' FROM decided"""))
def assessments(spark, sf):
    judged = fx.review_events(spark, sf).filter("role = 'judge'")
    human = p.normalize_assessments(judged, "judge", "human")
    model = p.normalize_assessments(papers(spark, sf).filter("screening_status = 'screened'").withColumns(
        {"ts": F.lit(None).cast("timestamp"), "event_id": F.col("doc_id")}), "primary", "llm", "m1")
    return human.unionByName(model).select("event_id", "role", "kind", "decision", "reason", "screening_status")
