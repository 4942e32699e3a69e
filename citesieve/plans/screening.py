"""Queries of the classifier screening operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.operators import screening as s
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry

QUERIES, ORACLES, register = registry()


def screened(spark: SparkSession, sf: str) -> DataFrame:
    return s.screen_classifier(fx.papers(spark, sf), fx.CRITERIA, fx.fixture_scores)


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Long criterion rows with the fixture scores."""
    eligible, _ = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    pairs = s.pair_papers_criteria(eligible, fx.CRITERIA)
    scores = fx.fixture_scores({"ord": F.col("ord")})
    return pairs.withColumns({name: scores[i] for i, name in enumerate(s.CLASSES)})


@register("screening_flagship", fx.sql(*fx.SCREENED, select="""
SELECT coalesce(d.decision, 'none') AS decision,
       coalesce(d.review_group, 'needs_processing') AS review_group, count(*) AS papers
FROM papers p LEFT JOIN decided d USING (batch_id, "row") GROUP BY ALL"""))
def flagship(spark, sf):
    return (screened(spark, sf).groupBy(F.coalesce("decision", F.lit("none")).alias("decision"), "review_group")
            .agg(F.count(F.lit(1)).alias("papers")))


@register("screen_classifier", fx.sql(*fx.SCREENED, select="""
SELECT p.batch_id, p."row", CASE WHEN abstract = '' THEN 'missing_abstract' ELSE 'screened' END AS screening_status,
       d.decision, coalesce(d.reason, 'missing_abstract') AS reason, d.decision_confidence,
       coalesce(d.review_group, 'needs_processing') AS review_group, coalesce(d.group_rank, 4)::INT AS group_rank,
       coalesce(d.blocking_count, 0)::INT AS blocking_count, d.score_gap
FROM papers p LEFT JOIN decided d USING (batch_id, "row")"""))
def screen(spark, sf):
    return screened(spark, sf).select(
        "batch_id", "row", "screening_status", "decision", "reason", "decision_confidence", "review_group",
        "group_rank", "blocking_count", "score_gap")


@register("route_unprocessed", fx.sql(fx.SQL_PAPERS, select="""
SELECT batch_id, "row", 'missing_abstract' AS screening_status, 'missing_abstract' AS reason,
       'needs_processing' AS review_group, 4::INT AS group_rank FROM papers WHERE abstract = ''"""))
def unprocessed(spark, sf):
    _, rest = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    return rest.select("batch_id", "row", "screening_status", "reason", "review_group", "group_rank")


@register("pair_papers_criteria", fx.sql(fx.SQL_PAPERS, fx.SQL_CRITERIA, select="""
SELECT batch_id, "row", ord::INT AS ord, label, type, threshold AS confidence_threshold
FROM papers CROSS JOIN crit WHERE abstract <> ''"""))
def pairs(spark, sf):
    eligible, _ = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    return s.pair_papers_criteria(eligible, fx.CRITERIA).select(
        "batch_id", "row", "ord", "label", "type", "confidence_threshold")


def length_scorer():
    """Arithmetic stand-in for a model: scores from text lengths, computed on batches of pairs."""
    import numpy as np

    def score(premises, hypotheses):
        n = np.array([len(p) + len(h) for p, h in zip(premises, hypotheses)], dtype=float)
        parts = np.stack([1 + n % 7, 1 + n % 11, 1 + n % 5], axis=1)
        return parts / parts.sum(axis=1, keepdims=True)

    return score


SQL_LENGTHS = """pairs AS (
  SELECT p.*, c.*, length('Title: ' || title || chr(10) || 'Abstract: ' || trim(abstract, ' ' || chr(10))) + length(statement) AS n
  FROM papers p CROSS JOIN crit c WHERE abstract <> ''),
parts AS (SELECT *, (1 + n % 7)::DOUBLE AS e, (1 + n % 11)::DOUBLE AS c3, (1 + n % 5)::DOUBLE AS n3 FROM pairs)"""


@register("score_pairs", fx.sql(fx.SQL_PAPERS, fx.SQL_CRITERIA, SQL_LENGTHS, select="""
SELECT batch_id, "row", ord::INT AS ord, round(e / (e + c3 + n3), 9) AS entailment, round(c3 / (e + c3 + n3), 9) AS contradiction,
       round(n3 / (e + c3 + n3), 9) AS neutral FROM parts"""))
def scores(spark, sf):
    eligible, _ = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    scored = s.score_pairs(s.pair_papers_criteria(eligible, fx.CRITERIA), s.PairScorer(length_scorer))
    return scored.select("batch_id", "row", "ord", *[F.round(c, 9).alias(c) for c in s.CLASSES])


SQL_TOKENS = r"""tokens AS (
  SELECT p.batch_id, p."row", c.ord, c.label,
         len(regexp_extract_all('Title: ' || title || chr(10) || 'Abstract: ' || abstract, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]'))
         + len(regexp_extract_all(statement, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n
  FROM papers p CROSS JOIN crit c WHERE abstract <> '')"""


@register("flag_overlong", fx.sql(fx.SQL_PAPERS, fx.SQL_CRITERIA, SQL_TOKENS, select="""
SELECT batch_id, "row", 'input_too_long' AS screening_status,
       string_agg(label || ':' || n || '>' || 500 || '+' || (n - 500), '; ' ORDER BY ord) AS issues
FROM tokens WHERE n > 500 GROUP BY ALL"""))
def overlong(spark, sf):
    eligible, _ = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    pairs = s.pair_papers_criteria(eligible, fx.CRITERIA)
    text = s.premise("title", "abstract")
    tokens = s.token_count(text) + s.token_count(F.col("statement"))
    pairs = pairs.withColumn("token_count", tokens).withColumn("token_limit", F.lit(500)).withColumn(
        "excess_tokens", F.greatest(F.col("token_count") - 500, F.lit(0)))
    _, issues = s.flag_overlong(pairs)
    shown = F.transform("input_issues", lambda x: F.concat(
        x["criterion"], F.lit(":"), x["token_count"], F.lit(">"), x["token_limit"], F.lit("+"), x["excess_tokens"]))
    return issues.select("batch_id", "row", "screening_status", F.array_join(shown, "; ").alias("issues"))


@register("check_scores", fx.sql(*fx.SCREENED[:3], select="""
SELECT batch_id, "row", 'screening_failed' AS screening_status, 'invalid_classifier_scores' AS reason
FROM (SELECT *, CASE WHEN doc_id % 13 = 4 AND ord = 2 THEN neutral + 0.01 ELSE neutral END AS n2 FROM scored)
GROUP BY ALL HAVING bool_or(abs(entailment + contradiction + n2 - 1) > 1e-4)"""))
def bad_scores(spark, sf):
    damaged = scored_pairs(spark, sf).withColumn("neutral", F.when(
        (F.col("doc_id") % 13 == 4) & (F.col("ord") == 2), F.col("neutral") + 0.01).otherwise(F.col("neutral")))
    return s.check_scores(damaged, len(fx.CRITERIA))


@register("argmax_label", fx.sql(*fx.SCREENED[:4], select="""
SELECT batch_id, "row", ord::INT AS ord, status, confidence FROM outcome"""))
def argmax(spark, sf):
    return s.with_outcome(scored_pairs(spark, sf)).select("batch_id", "row", "ord", "status", "confidence")


@register("resolve_threshold", fx.sql(fx.SQL_PAPERS, fx.SQL_CRITERIA, select="""
SELECT batch_id, "row", label, CASE label WHEN 'Population' THEN 0.9::DOUBLE ELSE CASE WHEN ord = 2 THEN 0.8::DOUBLE ELSE threshold END END
       AS confidence_threshold FROM papers CROSS JOIN crit WHERE abstract <> ''"""))
def thresholds(spark, sf):
    eligible, _ = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    pairs = s.pair_papers_criteria(eligible, fx.CRITERIA)
    pairs = pairs.withColumn("confidence_threshold", F.when(F.col("ord") != 2, F.col("confidence_threshold")))
    return s.resolve_threshold(pairs, {"Population": 0.9}).select("batch_id", "row", "label", "confidence_threshold")


@register("criterion_finding", fx.sql(*fx.SCREENED[:4], select="""
SELECT label, finding, count(*) AS n FROM outcome GROUP BY ALL"""))
def findings(spark, sf):
    return s.with_outcome(scored_pairs(spark, sf)).groupBy("label", "finding").agg(F.count(F.lit(1)).alias("n"))


@register("criterion_decision", fx.sql(*fx.SCREENED[:4], select="""
SELECT batch_id, "row", label, criterion_decision FROM outcome"""))
def decisions(spark, sf):
    return s.with_outcome(scored_pairs(spark, sf)).select("batch_id", "row", "label", "criterion_decision")


@register("aggregate_paper", fx.sql(*fx.SCREENED, select="""
SELECT batch_id, "row", decision, reason, decision_confidence FROM decided"""))
def aggregate(spark, sf):
    return s.aggregate_paper(s.with_outcome(scored_pairs(spark, sf)))


@register("review_order", fx.sql(*fx.SCREENED, select="""
SELECT review_group, group_rank, blocking_count, count(*) AS papers, min(score_gap) AS smallest_gap, max(score_gap) AS largest_gap
FROM decided GROUP BY ALL"""))
def order(spark, sf):
    nested = s.decide(s.nest_criteria(s.with_outcome(scored_pairs(spark, sf)).select(
        "batch_id", "row", "ord", "label", "type", *s.CLASSES, "finding", "criterion_decision", "confidence")))
    return nested.groupBy("review_group", "group_rank", "blocking_count").agg(
        F.count(F.lit(1)).alias("papers"), F.min("score_gap").alias("smallest_gap"), F.max("score_gap").alias("largest_gap"))


@register("failure_summary", fx.sql(fx.SQL_PAPERS, select="""
SELECT count(*) FILTER (abstract <> '' AND doc_id % 13 = 4) AS failed, count(*) AS papers,
       arg_min("row", struct_pack(b := batch_id, r := "row")) FILTER (abstract <> '' AND doc_id % 13 = 4) AS first_row,
       'invalid_classifier_scores' AS first_reason FROM papers"""))
def failures(spark, sf):
    def damaged(criterion):
        scores = fx.fixture_scores(criterion)
        return F.when(F.col("doc_id") % 13 == 4, F.transform(scores, lambda x: x + 0.01)).otherwise(scores)

    return s.failure_summary(s.screen_classifier(fx.papers(spark, sf), fx.CRITERIA, damaged))
