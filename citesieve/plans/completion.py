"""Queries of completion-model screening. Replies are derived from the documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from citesieve.functions.models import Completer
from citesieve.operators import completion as c
from citesieve.operators import screening as s
from citesieve.operators.calls import CallLog
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry
from citesieve.session import new_folder

QUERIES, ORACLES, register = registry()

CFG = c.CompletionConfig(extract_evidence=True, include_confidence_score=True, allow_uncertainty=True)


def replies(spark, sf):
    """One reply per paper and criterion: sound ones, and one of each fault."""
    eligible, _ = s.route_unprocessed(fx.papers(spark, sf), fx.CRITERIA)
    pairs = s.pair_papers_criteria(eligible, fx.CRITERIA)
    turn = (F.col("doc_id") * 7 + F.col("ord") * 3) % 11
    head = F.substring("title", 1, 10)

    def body(decision, reason="seen", quote=head, confidence=F.lit(0.9)):
        return F.to_json(F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), quote.alias("quote"), confidence.alias("confidence")),
                         {"ignoreNullFields": "false"})

    none = F.lit(None).cast("string")
    text = (F.when(turn <= 2, body("yes")).when(turn == 3, body("no", quote=none, confidence=F.lit(1.7)))
            .when(turn == 4, body("uncertain", confidence=F.lit(None).cast("double"))).when(turn == 5, body("maybe"))
            .when(turn == 6, F.lit('{"decision":"yes","decision":"no","reason":"r","quote":null,"confidence":1}'))
            .when(turn == 7, body("no", quote=F.lit("zz not there zz"))).when(turn == 8, body("no", reason="  "))
            .when(turn == 9, F.lit('{"decision":"no","reason":"r","quote":null,"confidence":0.5,"extra":1}')).otherwise(body("no", quote=none)))
    completion = F.when(turn == 10, F.when(F.col("ord") == 3, "output_limit").otherwise("complete")).otherwise("complete")
    error = F.when((F.col("doc_id") + F.col("ord")) % 29 == 0, "The CONTEXT length was exceeded").when(
        (F.col("doc_id") + F.col("ord")) % 29 == 1, "connection refused")
    return pairs.withColumns({"text": text, "completion": completion, "error": error,
                              "elapsed_seconds": F.lit(0.5), "cache_hit": F.col("doc_id") % 5 == F.col("ord")})


SQL_REPLIES = """turned AS (SELECT p.*, c.*, (doc_id * 7 + ord * 3) % 11 AS turn FROM papers p CROSS JOIN crit c WHERE abstract <> ''),
reply AS (
  SELECT *, CASE turn WHEN 5 THEN 'invalid_decision' WHEN 6 THEN 'not_strict_json' WHEN 7 THEN 'quote_not_verbatim' WHEN 8 THEN 'blank_reason'
                      WHEN 9 THEN 'unexpected_or_missing_keys' END AS reply_error,
         CASE WHEN turn <= 2 THEN 'yes' WHEN turn IN (3, 7, 8, 9, 10) THEN 'no' WHEN turn = 4 THEN 'uncertain' WHEN turn = 5 THEN 'maybe' END AS reply_decision,
         CASE WHEN turn IN (0, 1, 2, 5, 7, 8, 10) THEN 0.9::DOUBLE WHEN turn = 9 THEN 0.5::DOUBLE END AS reply_confidence,
         CASE WHEN turn IN (0, 1, 2, 4, 5, 8) THEN left(title, 10) WHEN turn = 7 THEN 'zz not there zz' END AS reply_quote,
         CASE (doc_id + ord) % 29 WHEN 0 THEN 'input_too_long' WHEN 1 THEN 'screening_failed' END AS error_status,
         turn = 10 AND ord = 3 AS limited
  FROM turned),
called AS (
  SELECT *, CASE WHEN error_status IS NOT NULL THEN error_status WHEN limited THEN 'output_too_long' WHEN reply_error IS NOT NULL THEN 'screening_failed' ELSE 'screened' END AS call_status
  FROM reply)"""
CALLED = (fx.SQL_PAPERS, fx.SQL_CRITERIA, SQL_REPLIES)


def checked(spark, sf):
    return c.check_contract(replies(spark, sf), CFG)


def called(spark, sf):
    return checked(spark, sf).withColumn("call_status", c.classify_error(F.col("completion"), F.col("error"), F.col("reply_error")))


@register("check_contract", fx.sql(*CALLED, select='SELECT batch_id, "row", ord::INT AS ord, reply_error FROM reply'))
def contract(spark, sf):
    return checked(spark, sf).select("batch_id", "row", "ord", "reply_error")


@register("parse_response", fx.sql(*CALLED, select="SELECT reply_decision, count(*) AS n FROM reply GROUP BY ALL"))
def parsed(spark, sf):
    return checked(spark, sf).groupBy("reply_decision").agg(F.count(F.lit(1)).alias("n"))


@register("sanitize_confidence", fx.sql(*CALLED, select='SELECT batch_id, "row", ord::INT AS ord, reply_confidence FROM reply'))
def confidence(spark, sf):
    return checked(spark, sf).select("batch_id", "row", "ord", "reply_confidence")


@register("check_verbatim_quote", fx.sql(*CALLED, select="""
SELECT batch_id, "row", ord::INT AS ord, reply_quote, turn <> 7 AS verbatim FROM reply WHERE reply_quote IS NOT NULL"""))
def verbatim(spark, sf):
    quoted = checked(spark, sf).filter("reply_quote IS NOT NULL")
    return quoted.select("batch_id", "row", "ord", "reply_quote", c.verbatim_quote(F.col("reply_quote")).alias("verbatim"))


@register("check_budget", fx.sql(fx.SQL_PAPERS, select="""
SELECT doc_id, strlen(title) + strlen(abstract) + 100 AS input_bytes, strlen(title) + strlen(abstract) + 100 > 7424 AS too_long FROM papers"""))
def budget(spark, sf):
    requests = fx.papers(spark, sf).withColumn("payload", F.concat("title", "abstract"))
    return c.check_budget(requests, c.CompletionConfig(request_overhead_bytes=100)).select("doc_id", F.col("input_bytes").cast("bigint").alias("input_bytes"), "too_long")


@register("classify_error", fx.sql(*CALLED, select="SELECT call_status, count(*) AS n FROM called GROUP BY ALL"))
def classified(spark, sf):
    return called(spark, sf).groupBy("call_status").agg(F.count(F.lit(1)).alias("n"))


@register("map_findings", fx.sql(*CALLED, select="""
SELECT batch_id, "row", ord::INT AS ord, CASE reply_decision WHEN 'yes' THEN 'supported' WHEN 'no' THEN 'contradicted' ELSE 'uncertain' END AS finding,
       CASE reply_decision WHEN 'yes' THEN CASE type WHEN 'include' THEN 'passed' ELSE 'hit' END WHEN 'no' THEN CASE type WHEN 'include' THEN 'failed' ELSE 'cleared' END
            ELSE CASE WHEN type = 'include' AND explicit THEN 'failed' ELSE 'unresolved' END END AS criterion_decision
FROM called WHERE call_status = 'screened'"""))
def findings(spark, sf):
    return c.map_findings(called(spark, sf).filter("call_status = 'screened'")).select("batch_id", "row", "ord", "finding", "criterion_decision")


@register("first_failure", fx.sql(*CALLED, select="""
SELECT batch_id, "row", ord::INT AS ord, call_status FROM called
QUALIFY ord <= coalesce(min(CASE WHEN call_status <> 'screened' THEN ord END) OVER (PARTITION BY batch_id, "row"), 99)"""))
def first(spark, sf):
    return c.first_failure(called(spark, sf)).select("batch_id", "row", "ord", "call_status")


@register("criterion_replies", fx.sql(*CALLED, select="""
SELECT batch_id, "row", coalesce(arg_min(call_status, ord) FILTER (call_status <> 'screened'), 'screened') AS screening_status FROM called GROUP BY ALL"""))
def replied(spark, sf):
    out = c.criterion_replies(called(spark, sf).withColumn("call_reason", F.coalesce("error", "reply_error")))
    return out.select("batch_id", "row", "screening_status")


@register("call_audit", fx.sql(*CALLED, select="""
SELECT batch_id, "row", count(*) AS calls, count(*) FILTER (doc_id % 5 = ord) AS cache_hits, 0.5 * count(*) FILTER (doc_id % 5 <> ord)::DOUBLE AS elapsed_seconds
FROM called GROUP BY ALL"""))
def audit(spark, sf):
    calls = called(spark, sf).withColumns({"input_tokens": F.lit(1), "output_tokens": F.lit(1)})
    return c.call_audit(calls).select("batch_id", "row", "calls", "cache_hits", F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"))


@register("resume", fx.sql(fx.SQL_PAPERS, select="""
SELECT batch_id, "row", doc_id % 7 IN (2, 3, 4, 5) AS is_reused FROM papers"""))
def resumed(spark, sf):
    turn = F.col("doc_id") % 7
    done = fx.papers(spark, sf).withColumns({
        "fingerprint": F.when(turn == 6, "old").otherwise("now"),
        "screening_status": F.when(turn == 0, "screening_failed").when(turn == 1, "output_too_long").otherwise("screened")})
    todo, reused = c.resume(fx.papers(spark, sf), done, "now")
    return todo.select("batch_id", "row", F.lit(False).alias("is_reused")).unionByName(reused.select("batch_id", "row", F.lit(True).alias("is_reused")))


def letter_completer():
    """Stand-in for a model: the answer depends on the request length; some first answers are faulty."""
    def complete(system, user, max_tokens):
        n = len(json.loads(user)["abstract"])
        if n % 17 == 0 and max_tokens < 1000:
            return {"text": "", "completion": "output_limit"}
        if n % 19 == 0:
            return {"text": "not json", "completion": "complete", "input_tokens": n, "output_tokens": 2}
        return {"text": json.dumps({"decision": "yes" if n % 3 else "no", "reason": f"length {n}"}), "input_tokens": n, "output_tokens": 9}

    return complete


LONG = c.CompletionConfig(context_tokens=10_000_000)
#: Requests differ by abstract, title and criterion; those of one abstract end alike at every criterion.
SQL_ASKED = """asked AS (
  SELECT *, length(abstract) % 19 = 0 AS faulty, length(abstract) % 3 <> 0 AS yes, length(abstract) % 17 = 0 AND length(abstract) % 19 <> 0 AS limited
  FROM papers WHERE abstract <> '')"""


@register("screen_completer", fx.sql(fx.SQL_PAPERS, SQL_ASKED, select="""
SELECT p.batch_id, p."row", CASE WHEN p.abstract = '' THEN 'missing_abstract' WHEN faulty THEN 'screening_failed' ELSE 'screened' END AS screening_status,
       CASE WHEN NOT faulty THEN 'Exclude' END AS decision, CASE WHEN p.abstract = '' THEN 'missing_abstract' WHEN faulty THEN 'not_strict_json'
       WHEN yes THEN 'criterion_failed:Not primary' ELSE 'criterion_failed:Population, Intervention, Outcome' END AS reason,
       CASE WHEN NOT faulty THEN 'optional_check' ELSE 'needs_processing' END AS review_group
FROM papers p LEFT JOIN asked a ON p.doc_id = a.doc_id"""))
def completed(spark, sf):
    results, _ = c.screen_completer(fx.papers(spark, sf), fx.CRITERIA, Completer(letter_completer), LONG)
    return results.select("batch_id", "row", "screening_status", "decision", "reason", "review_group")


@register("screen_completer_calls", fx.sql(fx.SQL_PAPERS, SQL_ASKED, select="""
SELECT batch_id, "row", ord::INT AS ord, CASE WHEN faulty THEN 'screening_failed' ELSE 'screened' END AS call_status,
       (CASE WHEN faulty OR limited THEN 2 ELSE 1 END)::INT AS attempts FROM asked, range(0, 4) r(ord) WHERE ord = 0 OR NOT faulty"""))
def calls_made(spark, sf):
    """The calls that are made: none of a criterion after one of its paper failed."""
    _, calls = c.screen_completer(fx.papers(spark, sf), fx.CRITERIA, Completer(letter_completer), LONG)
    return calls.select("batch_id", "row", "ord", "call_status", F.size("attempts").alias("attempts"))


@register("screen_resume", fx.sql(fx.SQL_PAPERS, SQL_ASKED, "even AS (SELECT DISTINCT title, abstract FROM asked WHERE doc_id % 2 = 0)", """sent AS (
  SELECT DISTINCT a.title, a.abstract, faulty, limited, e.title IS NOT NULL AS early FROM asked a LEFT JOIN even e ON a.title = e.title AND a.abstract = e.abstract)""", select="""
SELECT batch_id, "row", ord::INT AS ord, NOT faulty AND (title, abstract) IN (SELECT (title, abstract) FROM even) AS cache_hit,
       (SELECT sum(CASE WHEN faulty THEN 2 WHEN limited THEN 8 ELSE 4 END) FROM sent WHERE early)::BIGINT AS calls_first,
       (SELECT coalesce(sum(CASE WHEN faulty THEN 2 WHEN early THEN 0 WHEN limited THEN 8 ELSE 4 END), 0) FROM sent)::BIGINT AS calls_second
FROM asked, range(0, 4) r(ord) WHERE ord = 0 OR NOT faulty"""))
def screened_twice(spark, sf):
    """Every second paper, then all of them with the same call log: only what the log can't answer is sent."""
    log = CallLog(spark, new_folder(spark, "calls"))
    papers, model = fx.papers(spark, sf), Completer(letter_completer, "letters-1")
    c.screen_completer(papers.filter("doc_id % 2 = 0"), fx.CRITERIA, model, LONG, log)
    first = log.rows().count()
    _, calls = c.screen_completer(papers, fx.CRITERIA, model, LONG, log)
    return calls.select("batch_id", "row", "ord", "cache_hit", F.lit(first).cast("bigint").alias("calls_first"), F.lit(log.rows().count() - first).cast("bigint").alias("calls_second"))


@register("screen_completer_overall", fx.sql(fx.SQL_PAPERS, select="""
SELECT batch_id, "row", CASE WHEN abstract = '' THEN 'missing_abstract' WHEN length(abstract) % 17 <> 0 AND length(abstract) % 19 = 0 THEN 'screening_failed'
         WHEN length(abstract) % 19 = 0 THEN 'screening_failed' ELSE 'screened' END AS screening_status,
       CASE WHEN abstract = '' OR length(abstract) % 19 = 0 THEN NULL WHEN length(abstract) % 3 <> 0 THEN 'Include' ELSE 'Exclude' END AS decision FROM papers"""))
def overall(spark, sf):
    cfg = c.CompletionConfig(context_tokens=200_000, mode="all_criteria")
    results, _ = c.screen_completer(fx.papers(spark, sf), fx.CRITERIA, Completer(letter_completer), cfg)
    return results.select("batch_id", "row", "screening_status", "decision")
