"""Queries of the label, agreement and calibration operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.operators import calibration as cal
from citesieve.operators import review as r
from citesieve.operators import screening as s
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry
from citesieve.plans.screening import screened

QUERIES, ORACLES, register = registry()

THRESHOLDS = {c["label"]: c["confidence_threshold"] for c in fx.CRITERIA}
NEW_THRESHOLDS = {"Population": 0.9, "Outcome": 0.75}
CFG = cal.CalibrationConfig(max_disagreement_rate=0.45)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Screened papers with human paper labels and criterion labels derived from ``labels``."""
    joined = screened(spark, sf).join(fx.human_labels(spark, sf), "doc_id", "left")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1

    def criterion(c):
        decision = (F.when(F.col("quality").isNull(), F.lit(None)).when((c["ord"] == 0) & toxic, "unresolved")
                    .when((c["ord"] == 2) & ~good & toxic, "unresolved")
                    .when(c["type"] == "include", F.when(good, "passed").otherwise("failed"))
                    .otherwise(F.when(toxic, "hit").otherwise("cleared")))
        found = (F.when((c["ord"] == 0) & toxic, "uncertain")
                 .when(c["ord"] == 2, F.when(good, "supported").when(toxic, "not_established").when(~toxic, "contradicted")))
        return (c.withField("human_decision", decision).withField("human_finding", found)
                .withField("human_labelled_at", F.lit(None).cast("timestamp")))

    return joined.withColumn("criteria", F.transform("criteria", criterion)).withColumn(
        "human_labelled_at", F.lit(None).cast("timestamp"))


SQL_ITEMS = """marked AS (
  SELECT o.*, h.quality, h.toxic, h.human_decision AS paper_label,
         CASE WHEN quality IS NULL THEN NULL WHEN ord = 0 AND toxic = 1 THEN 'unresolved' WHEN ord = 2 AND quality = 0 AND toxic = 1 THEN 'unresolved'
              WHEN type = 'include' THEN CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END
              ELSE CASE WHEN toxic = 1 THEN 'hit' ELSE 'cleared' END END AS human_decision,
         CASE WHEN ord = 0 AND toxic = 1 THEN 'uncertain' WHEN ord = 2 AND quality = 1 THEN 'supported'
              WHEN ord = 2 AND toxic = 1 THEN 'not_established' WHEN ord = 2 AND toxic = 0 THEN 'contradicted' END AS human_finding
  FROM outcome o LEFT JOIN human h USING (doc_id)),
classed AS (
  SELECT *, CASE WHEN human_finding IS NOT NULL THEN
                   CASE human_finding WHEN 'supported' THEN 'entailment' WHEN 'contradicted' THEN 'contradiction' WHEN 'not_established' THEN 'neutral' END
                 WHEN explicit AND human_decision = 'failed' THEN NULL
                 WHEN human_decision IN ('passed', 'hit') THEN 'entailment' WHEN human_decision IN ('failed', 'cleared') THEN 'contradiction'
                 WHEN human_decision = 'unresolved' THEN 'neutral' END AS reviewer_class
  FROM marked),
items AS (SELECT label, confidence AS score, threshold AS cur, (status <> reviewer_class) AS error FROM classed WHERE reviewer_class IS NOT NULL)"""

ITEMS = (*fx.SCREENED[:4], fx.SQL_LABELLED, SQL_ITEMS)

SQL_CANDIDATES = """edges AS (
  SELECT label, cur, score FROM items WHERE score BETWEEN 0.5 AND 1
  UNION SELECT DISTINCT label, cur, 0.5::DOUBLE FROM items UNION SELECT DISTINCT label, cur, 1::DOUBLE FROM items),
stepped AS (SELECT label, cur, score, lead(score) OVER (PARTITION BY label ORDER BY score) AS nxt FROM edges),
candidates AS (
  SELECT label, cur, (score + nxt) / 2 AS t FROM stepped WHERE nxt IS NOT NULL
  UNION SELECT DISTINCT label, cur, 0.5::DOUBLE FROM items UNION SELECT DISTINCT label, cur, 1::DOUBLE FROM items
  UNION SELECT DISTINCT label, cur, cur FROM items),
swept AS (
  SELECT c.label, c.cur, c.t, count(*) AS reviewed, count(*) FILTER (i.score >= c.t) AS accepted,
         count(*) FILTER (i.score >= c.t AND i.error) AS wrong
  FROM candidates c JOIN items i ON c.label = i.label GROUP BY ALL),
best AS (
  SELECT label, t, reviewed, accepted, wrong FROM swept WHERE accepted > 0 AND wrong / accepted <= 0.45
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY accepted DESC, wrong, abs(t - cur), t) = 1)"""


@register("latest_paper_labels", """
WITH e AS (SELECT user_id AS "row", ts, event_id, CASE event_type WHEN 'view' THEN 'Include' WHEN 'click' THEN 'Exclude' WHEN 'signup' THEN 'Maybe'
             WHEN 'purchase' THEN 'Likely include' END AS decision FROM events)
SELECT 'b0' AS batch_id, "row", decision AS human_decision,
       CASE WHEN decision IS NOT NULL THEN epoch_us(ts) ELSE -1 END AS labelled_us
FROM e QUALIFY row_number() OVER (PARTITION BY "row" ORDER BY ts DESC, event_id DESC) = 1""")
def paper_labels(spark, sf):
    labels, _ = r.latest_paper_labels(fx.label_events(spark, sf))
    return labels.select("batch_id", "row", "human_decision", F.coalesce(F.unix_micros("human_labelled_at"), F.lit(-1)).alias("labelled_us"))


def criterion_events(spark, sf):
    kind = F.col("event_type")
    return fx.table(spark, sf, "events").join(
        fx.papers(spark, sf).select("batch_id", "row"), F.col("user_id") == F.col("row")).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "batch_id", "row", (F.col("event_id") % 5).cast("int").alias("ord"),
        F.when(kind == "view", "supported").when(kind == "click", "contradicted").when(kind == "signup", "uncertain").alias("human_finding"),
        F.when(kind == "view", "passed").when(kind == "click", "cleared").when(kind == "signup", "unresolved")
        .when(kind == "purchase", "hit").alias("human_decision"))


SQL_CRITERION_EVENTS = """cev AS (
  SELECT e.event_id, e.ts, p.batch_id, p."row", (e.event_id % 5)::INT AS ord, p.abstract,
         CASE event_type WHEN 'view' THEN 'supported' WHEN 'click' THEN 'contradicted' WHEN 'signup' THEN 'uncertain' END AS human_finding,
         CASE event_type WHEN 'view' THEN 'passed' WHEN 'click' THEN 'cleared' WHEN 'signup' THEN 'unresolved' WHEN 'purchase' THEN 'hit' END AS human_decision
  FROM events e JOIN papers p ON e.user_id = p."row"),
judged AS (
  SELECT *, CASE WHEN ord > 3 OR abstract = '' THEN 'criterion_not_found'
                 WHEN (ord < 3 AND human_decision IN ('hit', 'cleared')) OR (ord = 3 AND human_decision IN ('passed', 'failed')) THEN 'decision_not_valid_for_type'
                 WHEN human_finding = 'supported' AND human_decision <> CASE WHEN ord < 3 THEN 'passed' ELSE 'hit' END THEN 'finding_and_decision_differ'
                 WHEN human_finding = 'contradicted' AND human_decision <> CASE WHEN ord < 3 THEN 'failed' ELSE 'cleared' END THEN 'finding_and_decision_differ'
                 END AS reject_reason
  FROM cev)"""


@register("latest_criterion_labels", fx.sql(fx.SQL_PAPERS, SQL_CRITERION_EVENTS, select="""
SELECT batch_id, "row", ord, human_finding, human_decision FROM judged WHERE reject_reason IS NULL
QUALIFY row_number() OVER (PARTITION BY "row", ord ORDER BY ts DESC, event_id DESC) = 1"""))
def criterion_labels(spark, sf):
    labels, _ = r.latest_criterion_labels(criterion_events(spark, sf), screened(spark, sf), fx.CRITERIA)
    return labels.drop("human_labelled_at")


@register("rejected_criterion_labels", fx.sql(fx.SQL_PAPERS, SQL_CRITERION_EVENTS, select="""
SELECT event_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL"""))
def rejected_labels(spark, sf):
    _, rejected = r.latest_criterion_labels(criterion_events(spark, sf), screened(spark, sf), fx.CRITERIA)
    return rejected.select("event_id", "reject_reason")


CHANGED = [{**c, "statement": c["statement"] + " (revised)"} if i == 1 else c for i, c in enumerate(fx.CRITERIA)]


@register("carry_labels", fx.sql(*ITEMS, select="""
SELECT batch_id, "row", ord::INT AS ord, paper_label, CASE WHEN ord <> 1 THEN human_decision END AS human_decision,
       CASE WHEN ord <> 1 THEN human_finding END AS human_finding FROM marked"""))
def carried(spark, sf):
    new = s.screen_classifier(fx.papers(spark, sf), CHANGED, fx.fixture_scores)
    out = r.carry_labels(new, labelled(spark, sf))
    return s.long_criteria(out, ["human_decision"]).toDF(
        *["batch_id", "row", "paper_label"], *[f"c_{f}" for f in out.schema["criteria"].dataType.elementType.fieldNames()]).select(
        "batch_id", "row", F.col("c_ord").alias("ord"), "paper_label", F.col("c_human_decision").alias("human_decision"),
        F.col("c_human_finding").alias("human_finding"))


@register("stale_reviews", fx.sql(*ITEMS, select="""
SELECT batch_id, "row", label, human_decision FROM marked WHERE ord = 1 AND human_decision IS NOT NULL"""))
def stale(spark, sf):
    first = r.stale_reviews(labelled(spark, sf), CHANGED)
    return r.stale_reviews(labelled(spark, sf), CHANGED, first).select("batch_id", "row", "label", "human_decision")


SQL_AGREE = """pairs AS (SELECT h.human_decision AS human, d.decision AS machine FROM decided d JOIN human h USING (doc_id)),
grid AS (SELECT h.v AS human, m.v AS machine FROM (VALUES ('Include'), ('Likely include'), ('Exclude'), ('Maybe')) h(v),
         (VALUES ('Include'), ('Likely include'), ('Exclude'), ('Maybe')) m(v))"""


@register("agreement_table", fx.sql(*fx.SCREENED, fx.SQL_LABELLED, SQL_AGREE, select="""
SELECT g.human, g.machine, count(p.human) AS n FROM grid g LEFT JOIN pairs p USING (human, machine) GROUP BY ALL"""))
def confusion(spark, sf):
    return r.agreement(labelled(spark, sf))[1]


@register("agreement", fx.sql(*fx.SCREENED, fx.SQL_LABELLED, SQL_AGREE, select="""
SELECT count(*) AS reviewed, count(*) FILTER (human = machine) AS agreeing,
       count(*) FILTER (human = machine) / count(*) AS agreement_rate FROM pairs"""))
def agreement(spark, sf):
    return r.agreement(labelled(spark, sf))[0]


SQL_RETHRESHOLD = fx.SQL_CRITERIA.replace("0.6::DOUBLE", "0.9::DOUBLE").replace("0.5::DOUBLE", "0.75::DOUBLE")


@register("reclassify", fx.sql(fx.SQL_PAPERS, SQL_RETHRESHOLD, *fx.SCREENED[2:], select="""
SELECT p.batch_id, p."row", d.decision, coalesce(d.reason, 'missing_abstract') AS reason, d.decision_confidence,
       coalesce(d.review_group, 'needs_processing') AS review_group, d.score_gap
FROM papers p LEFT JOIN decided d USING (batch_id, "row")"""))
def reclassified(spark, sf):
    return r.reclassify(screened(spark, sf), NEW_THRESHOLDS).select(
        "batch_id", "row", "decision", "reason", "decision_confidence", "review_group", "score_gap")


@register("check_thresholds", """
WITH requests AS (SELECT source AS label, 0.4 + (doc_id % 8) * 0.1::DOUBLE AS threshold, doc_id FROM documents),
named AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Population' WHEN 1 THEN 'Outcome' ELSE label END AS label, (4 + doc_id % 8)::DOUBLE / 10 AS threshold FROM requests)
SELECT doc_id, label, threshold, CASE WHEN label NOT IN ('Population', 'Outcome') THEN 'unknown_label' ELSE 'outside_range' END AS reject_reason
FROM named WHERE label NOT IN ('Population', 'Outcome') OR threshold NOT BETWEEN 0.5 AND 1""")
def thresholds(spark, sf):
    turn = F.col("doc_id") % 4
    requests = fx.table(spark, sf, "documents").select(
        "doc_id", F.when(turn == 0, "Population").when(turn == 1, "Outcome").otherwise(F.col("source")).alias("label"),
        ((4 + F.col("doc_id") % 8).cast("double") / 10).alias("threshold"))
    return r.check_thresholds(requests, fx.CRITERIA)


@register("useful_reason", fx.sql(*fx.SCREENED, select="""
SELECT batch_id, "row", CASE WHEN lang = 'fr' THEN 'model says' WHEN d.reason <> 'all_criteria_passed' THEN d.reason END AS useful
FROM papers JOIN decided d USING (batch_id, "row")"""))
def useful(spark, sf):
    done = screened(spark, sf).filter("screening_status = 'screened'")
    model = F.when(F.col("lang") == "fr", "model says").when(F.col("lang") == "de", "")
    return done.select("batch_id", "row", r.useful_reason(model, "reason").alias("useful"))


@register("estimate_calls", fx.sql(fx.SQL_PAPERS, select="""
SELECT batch_id, count(*) AS papers, count(*) * 5 AS minimum_calls, count(*) * 6 AS maximum_calls FROM papers GROUP BY ALL"""))
def calls(spark, sf):
    return r.estimate_calls(fx.papers(spark, sf), len(fx.CRITERIA), second_reviewer="llm", judge="llm")


@register("batch_summary", fx.sql(fx.SQL_PAPERS, select="""
SELECT batch_id, count(*) AS paper_count, bool_or(abstract <> '') AS has_results, batch_id || '.csv' AS filename FROM papers GROUP BY ALL"""))
def summary(spark, sf):
    files = fx.papers(spark, sf).select("batch_id").distinct().withColumn("filename", F.concat("batch_id", F.lit(".csv")))
    done = screened(spark, sf).filter("screening_status = 'screened'")
    return r.batch_summary(fx.papers(spark, sf), done, files)


@register("validate_results", fx.sql(*fx.SCREENED, select="""
SELECT batch_id, "row", CASE WHEN p.lang = 'es' THEN CASE WHEN d.score_gap IS NULL THEN 'decision' ELSE 'decision,score_gap' END ELSE 'score_gap' END AS violations
FROM papers p LEFT JOIN decided d USING (batch_id, "row")
WHERE p.lang = 'es' OR (p.lang = 'de' AND d.score_gap IS NOT NULL)"""))
def invalid(spark, sf):
    damaged = screened(spark, sf).withColumns({
        "decision": F.when(F.col("lang") == "es", "Perhaps").otherwise(F.col("decision")),
        "score_gap": F.when(F.col("lang").isin("de", "es"), F.col("score_gap") + 2).otherwise(F.col("score_gap"))})
    return r.validate_results(damaged).select("batch_id", "row", F.array_join("violations", ",").alias("violations"))


@register("reviewer_class", fx.sql(*ITEMS, select="""
SELECT batch_id, "row", label, reviewer_class FROM classed WHERE reviewer_class IS NOT NULL"""))
def classes(spark, sf):
    return cal.labelled_items(labelled(spark, sf)).select("batch_id", "row", "label", "reviewer_class")


@register("labelled_items", fx.sql(*ITEMS, select="SELECT label, score, error FROM items"))
def items(spark, sf):
    return cal.labelled_items(labelled(spark, sf)).select("label", "score", "error")


@register("threshold_metrics", fx.sql(*ITEMS, select="""
SELECT label, cur AS threshold, count(*) AS reviewed, count(*) FILTER (score >= cur) AS accepted,
       count(*) FILTER (score >= cur AND error) AS disagreements, count(*) FILTER (score >= cur AND NOT error) AS agreements,
       count(*) FILTER (score < cur) AS uncertain, count(*) FILTER (score >= cur) / count(*) AS coverage,
       count(*) FILTER (score >= cur AND error) / nullif(count(*) FILTER (score >= cur), 0) AS disagreement_rate
FROM items GROUP BY label, cur"""))
def metrics(spark, sf):
    return cal.threshold_metrics(cal.labelled_items(labelled(spark, sf)), THRESHOLDS)


@register("candidate_thresholds", fx.sql(*ITEMS, SQL_CANDIDATES, select="SELECT label, t AS threshold FROM candidates"))
def candidates(spark, sf):
    return cal.candidate_thresholds(cal.labelled_items(labelled(spark, sf)), THRESHOLDS)


@register("best_threshold", fx.sql(*ITEMS, SQL_CANDIDATES, select="""
SELECT label, t AS threshold, reviewed, accepted, wrong AS disagreements FROM best"""))
def best(spark, sf):
    return cal.best_threshold(cal.labelled_items(labelled(spark, sf)), THRESHOLDS, 0.45).select(
        "label", "threshold", "reviewed", "accepted", "disagreements")


@register("threshold_stability")
def stability(spark, sf):
    cfg = cal.CalibrationConfig(max_disagreement_rate=0.5, bootstrap_enabled=True, bootstrap_samples=20)
    return cal.threshold_stability(cal.labelled_items(labelled(spark, sf)), THRESHOLDS, cfg)


SQL_DIAGNOSTICS = """diag AS (
  SELECT label, count(*) AS assessed, count(*) FILTER (status = 'neutral' AND confidence >= threshold) AS neutral_count,
         count(*) FILTER (confidence < threshold) AS uncertain_count FROM outcome GROUP BY ALL),
flagged AS (
  SELECT *, neutral_count / assessed AS neutral_rate, uncertain_count / assessed AS uncertain_rate,
         concat_ws(',', CASE WHEN assessed >= 10 AND neutral_count / assessed >= 0.5 THEN 'frequently_neutral' END,
                   CASE WHEN assessed >= 10 AND uncertain_count / assessed >= 0.3 THEN 'frequently_uncertain' END) AS flags
  FROM diag)"""


@register("criterion_diagnostics", fx.sql(*fx.SCREENED[:4], SQL_DIAGNOSTICS, select="SELECT * FROM flagged"))
def diagnostics(spark, sf):
    out = cal.criterion_diagnostics(cal.criterion_items(labelled(spark, sf)), THRESHOLDS, CFG)
    return out.withColumn("flags", F.array_join("flags", ",")).drop("type", "enough_papers")


@register("overall_metrics", fx.sql(*ITEMS, select="""
SELECT count(*) AS reviewed, count(*) FILTER (score >= cur) AS accepted, count(*) FILTER (score >= cur AND error) AS disagreements,
       count(*) FILTER (score >= cur AND NOT error) AS agreements, count(*) FILTER (score < cur) AS uncertain,
       count(*) FILTER (score >= cur) / count(*) AS coverage,
       count(*) FILTER (score >= cur AND error) / count(*) FILTER (score >= cur) AS disagreement_rate FROM items"""))
def overall(spark, sf):
    return cal.overall_metrics(cal.threshold_metrics(cal.labelled_items(labelled(spark, sf)), THRESHOLDS))


@register("calibrate", fx.sql(*ITEMS, SQL_CANDIDATES, SQL_DIAGNOSTICS, """cur AS (
  SELECT label, cur AS t, count(*) AS reviewed, count(*) FILTER (score >= cur) AS accepted, count(*) FILTER (score >= cur AND error) AS wrong
  FROM items GROUP BY ALL)""", select="""
SELECT c.label, c.threshold AS current_threshold, u.reviewed, u.accepted AS current_accepted, u.wrong AS current_disagreements,
       coalesce(b.t, c.threshold) AS suggested_threshold, coalesce(b.accepted, u.accepted) AS suggested_accepted,
       coalesce(b.wrong, u.wrong) AS suggested_disagreements, b.t IS NOT NULL AS ready,
       CASE WHEN b.t IS NULL THEN 'no_feasible_threshold' ELSE 'suggested' END AS tuning_status, 'disabled' AS stability, f.flags
FROM crit c JOIN cur u USING (label) LEFT JOIN best b USING (label) JOIN flagged f USING (label)"""))
def calibrated(spark, sf):
    report = cal.calibrate(labelled(spark, sf), THRESHOLDS, CFG)
    return report.select(
        "label", "current_threshold", "reviewed", "current_accepted", "current_disagreements", "suggested_threshold",
        "suggested_accepted", "suggested_disagreements", "ready", "tuning_status", "stability",
        F.array_join("flags", ",").alias("flags"))
