"""Two-reviewer panels: consensus, candidates for review, and the review event log.

Reviews are an append-only event table (keys, role, decision, reason, kind, ts, event_id); the
current reviews, the history and the consensus are views over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.functions.ordered import last_before
from citesieve.functions.text import blank_to_null
from citesieve.operators.review import useful_reason
from citesieve.operators.screening import KEYS

# Fixed values.
FINAL = ["Include", "Exclude"]
ROLES = ["second_reviewer", "judge"]

ORDER = ["ts", "event_id"]


def panel_status(status: Column, first: Column, has_second: Column, second: Column, has_judge: Column, judge: Column) -> Column:
    """Consensus status; the tests apply in this order."""
    return (F.when(status == "missing_abstract", "manual_full_text_required")
            .when(~status.eqNullSafe("screened"), "first_failed")
            .when(~has_second, "awaiting_second_reviewer")
            .when(~F.coalesce(second.isin(*FINAL), F.lit(False)), "second_reviewer_failed")
            .when(first.eqNullSafe(second), "agreed")
            .when(~has_judge, "awaiting_judge")
            .when(~F.coalesce(judge.isin(*FINAL), F.lit(False)), "judge_failed")
            .otherwise("adjudicated"))


def resolve_reviews(papers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Papers with ``consensus_status`` and ``consensus_decision``.

    ``reviews`` has one row per paper with the nullable structs ``second_reviewer`` and ``judge``
    (see :func:`fold_review_events`), so the join is on unique keys.
    """
    joined = papers.join(reviews, KEYS, "left")
    second, judge = F.col("second_reviewer"), F.col("judge")
    status = panel_status(F.col("screening_status"), F.col("decision"), second.isNotNull(), second["decision"],
                          judge.isNotNull(), judge["decision"])
    joined = joined.withColumn("consensus_status", status)
    return joined.withColumn("consensus_decision", F.when(F.col("consensus_status") == "agreed", second["decision"])
                             .when(F.col("consensus_status") == "adjudicated", judge["decision"]))


def fold_review_events(events: DataFrame) -> DataFrame:
    """Current reviews per paper: the last of each role; a later second review voids the judge.

    One grouping with partial aggregation, whatever the number of events of a paper.
    """
    fields = [c for c in events.columns if c not in KEYS]
    position, review = F.struct(*ORDER), F.struct(*fields)
    last = {role: F.max_by(review, F.when(F.col("role") == role, position)) for role in ROLES}
    folded = events.groupBy(*KEYS).agg(*[value.alias(role) for role, value in last.items()])
    newer = (F.struct(*[F.col(f"judge.{c}").alias(c) for c in ORDER])
             > F.struct(*[F.col(f"second_reviewer.{c}").alias(c) for c in ORDER]))
    return folded.withColumn("judge", F.when(F.col("second_reviewer").isNull() | newer, F.col("judge")))


def review_history(events: DataFrame) -> DataFrame:
    """Every event with the decision and reason its submission replaced.

    A second review removes the judge, so a judge event replaces nothing when a second review
    came between.
    """
    hour = F.date_trunc("hour", "ts")
    state = F.struct("role", "decision", "reason", *ORDER)
    seen = last_before(events, KEYS, ORDER, hour, F.when(F.col("role") == "second_reviewer", state), "_second")
    seen = last_before(seen, KEYS, ORDER, hour, F.when(F.col("role") == "judge", state), "_judge")
    after = F.col("_judge").isNotNull() & (F.col("_second").isNull() | (
        F.struct("_judge.ts", "_judge.event_id") > F.struct("_second.ts", "_second.event_id")))
    previous = F.when(F.col("role") == "second_reviewer", F.col("_second")).when(after, F.col("_judge"))
    return seen.withColumn("_p", previous).select(
        *KEYS, "role", "event_id", F.col("ts").alias("changed_at"),
        F.col("_p.decision").alias("previous_decision"), F.col("_p.reason").alias("previous_reason"))


def second_review_candidates(papers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Screened papers that have no Include or Exclude second review."""
    done = reviews.filter(F.col("second_reviewer.decision").isin(*FINAL)).select(*KEYS)
    return papers.filter("screening_status = 'screened'").join(done, KEYS, "left_anti")


def judge_candidates(papers: DataFrame, reviews: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Papers that wait for a judge, and the requested papers that do not exist or do not qualify."""
    resolved = resolve_reviews(papers, reviews)
    waiting = resolved.filter(F.col("consensus_status").isin("awaiting_judge", "judge_failed"))
    if requested is None:
        return waiting, papers.limit(0).select(*KEYS, F.lit("").alias("reject_reason"))
    asked = requested.select(*KEYS).distinct()
    rejects = asked.join(resolved.select(*KEYS, "consensus_status"), KEYS, "left").withColumn(
        "reject_reason", F.when(F.col("consensus_status").isNull(), "paper_not_found").when(
            ~F.col("consensus_status").isin("awaiting_judge", "judge_failed"), "not_awaiting_judge"))
    return waiting.join(asked, KEYS, "left_semi"), rejects.filter("reject_reason IS NOT NULL").select(*KEYS, "reject_reason")


def primary_assessment(papers: DataFrame) -> Column:
    """The first reviewer's result in assessment form; missing audit columns are null."""
    def has(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in papers.columns else F.lit(None).cast(kind)

    return F.struct(
        F.lit("primary").alias("role"), F.lit("llm").alias("kind"), F.col("decision").alias("decision"),
        useful_reason(has("llm_reason"), F.col("reason")).alias("reason"), has("llm_quote").alias("quote"),
        has("llm_confidence", "double").alias("confidence"), F.col("screening_status").alias("screening_status"))


def judge_payload(papers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Request body for the judge: title, abstract and both assessments as JSON."""
    waiting, _ = judge_candidates(papers, reviews)
    assessments = F.array(*[F.parse_json(F.to_json(x)) for x in (primary_assessment(waiting), F.col("second_reviewer"))])
    return waiting.select(*KEYS, F.to_json(F.struct(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        assessments.alias("reviewer_assessments"))).alias("payload"))


def stateless_reject(fingerprint: str, human_roles: list[str], require_judge_reason: bool = True) -> Column:
    """Faults of a submission that need no other row."""
    return (F.when(~F.col("fingerprint").eqNullSafe(fingerprint), "wrong_fingerprint")
            .when(~F.col("role").isin(*ROLES) | ~F.col("role").isin(*human_roles), "role_not_human")
            .when(F.lit(require_judge_reason) & (F.col("role") == "judge") & blank_to_null("reason").isNull(), "judge_needs_reason")
            .when(~F.coalesce(F.col("decision").isin(*FINAL), F.lit(False)), "invalid_decision"))


def check_review_events(events: DataFrame, papers: DataFrame, fingerprint: str, human_roles: list[str] = ROLES,
                        require_judge_reason: bool = True, base_reviews: DataFrame | None = None) -> DataFrame:
    """Every event with its ``reject_reason`` (null when accepted).

    A judge event is in order while the paper waits for a judge, or edits a human judge. After a
    valid second review that depends on that review alone: when it disagrees with the first
    reviewer every later judge event is accepted, otherwise none. Before one, the stored reviews decide.
    """
    first = papers.select(*KEYS, "screening_status", F.col("decision").alias("_first"))
    if base_reviews is not None:
        kind = F.col("judge.kind") if "kind" in base_reviews.schema["judge"].dataType.fieldNames() else F.lit("human")
        base = resolve_reviews(first.withColumnRenamed("_first", "decision"), base_reviews).select(
            *KEYS, (F.col("consensus_status").isin("awaiting_judge", "judge_failed") | F.coalesce(
                F.col("judge").isNotNull() & (kind == "human"), F.lit(False))).alias("_base_open"))
        first = first.join(base, KEYS, "left")
    else:
        first = first.withColumn("_base_open", F.lit(False))
    marked = events.withColumn("_fault", stateless_reject(fingerprint, human_roles, require_judge_reason))
    marked = marked.join(first, KEYS, "left")
    marked = marked.withColumn("_fault", F.coalesce(
        "_fault", F.when(F.col("screening_status").isNull(), "paper_not_found")
        .when(F.col("screening_status") != "screened", "not_ready")))
    valid_second = F.when(F.col("_fault").isNull() & (F.col("role") == "second_reviewer"), F.col("decision"))
    seen = last_before(marked, KEYS, ORDER, F.date_trunc("hour", "ts"), valid_second, "_second")
    is_open = F.when(F.col("_second").isNotNull(), ~F.col("_second").eqNullSafe(F.col("_first"))).otherwise(F.col("_base_open"))
    return seen.withColumn("reject_reason", F.coalesce(
        "_fault", F.when((F.col("role") == "judge") & ~is_open, "not_ready"))).select(*events.columns, "reject_reason")


def consensus(papers: DataFrame, reviews: DataFrame, fingerprint: str, roles: dict[str, str],
              require_judge_reason: bool = True) -> DataFrame:
    """Papers with the consensus struct shown to reviewers."""
    resolved = resolve_reviews(papers, reviews)
    return resolved.withColumn("consensus", F.struct(
        F.col("consensus_status").alias("status"), F.col("consensus_decision").alias("decision"),
        F.lit(fingerprint).alias("fingerprint"),
        F.create_map(*[F.lit(x) for pair in roles.items() for x in pair]).alias("roles"),
        F.lit(require_judge_reason).alias("require_judge_reason"), primary_assessment(papers).alias("primary"),
        "second_reviewer", "judge")).drop("second_reviewer", "judge", "consensus_status", "consensus_decision")


def panel_version(events: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """Reviews of the current run, and the archived ones of earlier fingerprints."""
    current = F.col("fingerprint").eqNullSafe(fingerprint)
    return events.filter(current), events.filter(~current)


def normalize_assessments(results: DataFrame, role: str, kind: str, model: str | None = None) -> DataFrame:
    """Model results or human decisions as review events of one shape; blank reasons become null."""
    def has(name: str, kind_of: str = "string") -> Column:
        return F.col(name) if name in results.columns else F.lit(None).cast(kind_of)

    human = kind == "human"
    reason = blank_to_null(has("reason")) if human else useful_reason(has("llm_reason"), has("reason"))
    return results.select(
        *KEYS, F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.col("decision").alias("decision"),
        reason.alias("reason"), has("llm_quote").alias("quote"), has("llm_confidence", "double").alias("confidence"),
        F.lit(None if human else model).cast("string").alias("model"), *[F.col(c) for c in ORDER],
        (F.lit("screened") if human else has("screening_status")).alias("screening_status"))
