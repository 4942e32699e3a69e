"""Criterion screening with a classifier.

Criteria are configuration: a short list of dicts. They are attached to each paper as an array
literal, so scoring, decisions and review order happen inside the paper's own row and the whole
screening is one map-only stage: no join, no shuffle, nothing to skew. The long form (one row
per paper and criterion) is the same expressions on exploded rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.functions.models import PairScorer
from citesieve.functions.text import clean_text, premise, token_count
from citesieve.functions.vectors import softmax
from citesieve.session import compute_once

KEYS = ["batch_id", "row"]
DEFAULT_THRESHOLD = 0.8
SCORE_SUM_TOLERANCE = 1e-4

# Fixed values.
CLASSES = ["entailment", "contradiction", "neutral"]
STATUSES = ["screened", "missing_abstract", "screening_failed", "input_too_long", "output_too_long"]
DECISIONS = ["Include", "Likely include", "Exclude", "Maybe"]


def criteria_array(criteria: list[dict], overrides: dict[str, float] | None = None,
                   default: float = DEFAULT_THRESHOLD) -> Column:
    """The criteria as one array literal, each with its resolved threshold."""
    items = [
        F.struct(
            F.lit(i).cast("int").alias("ord"), F.lit(c["label"]).alias("label"),
            F.lit(c["statement"]).alias("statement"), F.lit(c["type"]).alias("type"),
            F.lit(bool(c.get("explicit_evidence_required", False))).alias("explicit_evidence_required"),
            F.lit(threshold_of(c, overrides, default)).alias("confidence_threshold"))
        for i, c in enumerate(criteria)
    ]
    return F.array(*items)


def threshold_of(criterion: dict, overrides: dict[str, float] | None = None, default: float = DEFAULT_THRESHOLD) -> float:
    """Override by label, else the criterion's own threshold, else the default."""
    own = criterion.get("confidence_threshold")
    return float((overrides or {}).get(criterion["label"], default if own is None else own))


def resolve_threshold(df: DataFrame, overrides: dict[str, float] | None = None,
                      default: float = DEFAULT_THRESHOLD, label: str = "label") -> DataFrame:
    """Replace ``confidence_threshold`` of long criterion rows by the threshold in force."""
    return df.withColumn("confidence_threshold",
                         threshold_column(F.col(label), F.col("confidence_threshold"), overrides, default))


def threshold_column(label: Column, own: Column, overrides: dict[str, float] | None, default: float) -> Column:
    chosen = F.coalesce(own, F.lit(float(default)))
    for name, value in (overrides or {}).items():
        chosen = F.when(label == name, F.lit(float(value))).otherwise(chosen)
    return chosen


# --- one criterion ---------------------------------------------------------------------------

def argmax_label(e: Column, c: Column, n: Column) -> Column:
    """Largest class; ties go to entailment, then contradiction."""
    return F.when((e >= c) & (e >= n), "entailment").when(c >= n, "contradiction").otherwise("neutral")


def finding(status: Column, confidence: Column, threshold: Column) -> Column:
    return (F.when(confidence < threshold, "uncertain").when(status == "entailment", "supported")
            .when(status == "contradiction", "contradicted").otherwise("not_established"))


def criterion_decision(kind: Column, status: Column, confidence: Column, threshold: Column, explicit: Column) -> Column:
    include = kind == "include"
    return (
        F.when(confidence < threshold, "unresolved")
        .when(status == "neutral", F.when(include & explicit, "failed").otherwise("unresolved"))
        .when(status == "entailment", F.when(include, "passed").otherwise("hit"))
        .otherwise(F.when(include, "failed").otherwise("cleared"))
    )


def with_outcome(df: DataFrame) -> DataFrame:
    """Status, confidence, finding and decision of long criterion rows, from their scores and threshold."""
    e, c, n = (F.col(name) for name in CLASSES)
    df = df.withColumns({"status": argmax_label(e, c, n), "confidence": F.greatest(e, c, n)})
    threshold = F.col("confidence_threshold")
    return df.withColumns({
        "finding": finding(F.col("status"), F.col("confidence"), threshold),
        "criterion_decision": criterion_decision(F.col("type"), F.col("status"), F.col("confidence"), threshold,
                                                 F.col("explicit_evidence_required"))})


def outcome_struct(item: Column, threshold: Column | None = None) -> Column:
    """The same on one element of a criteria array; fields the element already has are kept."""
    e, c, n = (item[name] for name in CLASSES)
    limit = item["confidence_threshold"] if threshold is None else threshold
    status, confidence = argmax_label(e, c, n), F.greatest(e, c, n)
    return (item.withField("status", status).withField("confidence", confidence)
            .withField("confidence_threshold", limit).withField("finding", finding(status, confidence, limit))
            .withField("criterion_decision",
                       criterion_decision(item["type"], status, confidence, limit, item["explicit_evidence_required"])))


# --- one paper -------------------------------------------------------------------------------

def aggregate_criteria(criteria: Column) -> Column:
    """Decision, reason and confidence of a paper from its ordered criterion results."""
    includes = F.filter(criteria, lambda x: x["type"] == "include")
    excludes = F.filter(criteria, lambda x: x["type"] == "exclude")
    failures = F.concat(F.filter(includes, lambda x: x["criterion_decision"] == "failed"),
                        F.filter(excludes, lambda x: x["criterion_decision"] == "hit"))
    unresolved = F.filter(criteria, lambda x: x["criterion_decision"] == "unresolved")
    cleared = F.forall(excludes, lambda x: x["criterion_decision"] == "cleared")
    passed = (F.size(includes) > 0) & F.forall(includes, lambda x: x["criterion_decision"] == "passed")
    likely = (cleared & F.exists(includes, lambda x: x["criterion_decision"] == "passed")
              & F.forall(unresolved, lambda x: x["finding"] == "not_established"))
    failed, included = F.size(failures) > 0, passed & cleared

    def labels(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["label"]), ", ")

    def confidences(items: Column) -> Column:
        return F.transform(items, lambda x: x["confidence"])

    return F.struct(
        F.when(failed, "Exclude").when(included, "Include").when(likely, "Likely include").otherwise("Maybe").alias("decision"),
        F.when(failed, F.concat(F.lit("criterion_failed:"), labels(failures)))
        .when(included, "all_criteria_passed")
        .otherwise(F.concat(F.lit("unresolved_criteria:"), labels(unresolved))).alias("reason"),
        F.when(failed, F.array_max(confidences(failures)))
        .when(included, F.array_min(confidences(criteria))).alias("decision_confidence"))


def review_order(criteria: Column, decision: Column) -> Column:
    """Review group, rank, number of blocking criteria and smallest score gap of a decided paper."""
    unresolved = F.filter(criteria, lambda x: x["criterion_decision"] == "unresolved")
    uncertain = F.filter(unresolved, lambda x: x["finding"] == "uncertain")
    has_uncertain = F.size(uncertain) > 0
    relevant = (
        F.when(decision == "Maybe", F.when(has_uncertain, uncertain).otherwise(unresolved))
        .when(decision == "Likely include", unresolved)
        .when(decision == "Exclude", F.filter(criteria, lambda x: x["criterion_decision"].isin("failed", "hit")))
        .otherwise(criteria))

    def gap(x: Column) -> Column:
        ranked = F.sort_array(F.array(*[x[name] for name in CLASSES]), asc=False)
        return F.when(F.forall(ranked, lambda s: s.isNotNull()), ranked[0] - ranked[1])

    maybe = decision == "Maybe"
    return F.struct(
        F.when(maybe, F.when(has_uncertain, "uncertain").otherwise("missing_evidence"))
        .when(decision == "Likely include", "confirm_inclusion_gaps").otherwise("optional_check").alias("review_group"),
        F.when(maybe, F.when(has_uncertain, 0).otherwise(1)).when(decision == "Likely include", 2).otherwise(3).alias("group_rank"),
        F.when(maybe, F.size(unresolved)).otherwise(0).alias("blocking_count"),
        F.array_min(F.transform(relevant, gap)).alias("score_gap"))


def nest_criteria(long: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per paper with its ordered ``criteria`` array; an array is as long as the criteria list."""
    fields = [c for c in long.columns if c not in keys and c != "ord"]
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("criteria"))


def aggregate_paper(long: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Paper decisions from long criterion results, by one grouping with partial aggregation.

    Only counters, extremes and the labels of at most one criteria list cross the shuffle.
    """
    include, exclude = F.col("type") == "include", F.col("type") == "exclude"
    decided = F.col("criterion_decision")
    failure = (include & (decided == "failed")) | (exclude & (decided == "hit"))
    unresolved = decided == "unresolved"
    listed = F.struct(F.when(include, 0).otherwise(1).alias("side"), F.col("ord").alias("ord"), F.col("label").alias("label"))
    pending = F.struct(F.col("ord").alias("ord"), F.col("label").alias("label"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda x: x["label"]), ", ")

    sums = long.groupBy(*keys).agg(
        F.collect_list(F.when(failure, listed)).alias("_failures"),
        F.collect_list(F.when(unresolved, pending)).alias("_unresolved"),
        F.count_if(include).alias("_includes"),
        F.count_if(include & (decided == "passed")).alias("_passed"),
        F.count_if(exclude & (decided != "cleared")).alias("_uncleared"),
        F.count_if(unresolved & (F.coalesce(F.col("finding"), F.lit("")) != "not_established")).alias("_open"),
        F.max(F.when(failure, F.col("confidence"))).alias("_top"), F.min("confidence").alias("_low"))
    failed = F.size("_failures") > 0
    cleared = F.col("_uncleared") == 0
    included = (F.col("_includes") > 0) & (F.col("_passed") == F.col("_includes")) & cleared
    likely = cleared & (F.col("_passed") > 0) & (F.col("_open") == 0)
    return sums.select(
        *keys,
        F.when(failed, "Exclude").when(included, "Include").when(likely, "Likely include").otherwise("Maybe").alias("decision"),
        F.when(failed, F.concat(F.lit("criterion_failed:"), joined(F.col("_failures"))))
        .when(included, "all_criteria_passed")
        .otherwise(F.concat(F.lit("unresolved_criteria:"), joined(F.col("_unresolved")))).alias("reason"),
        F.when(failed, F.col("_top")).when(included, F.col("_low")).alias("decision_confidence"))


# --- routing, pairs and scores ---------------------------------------------------------------

def route(abstract, criteria: list[dict]) -> Column:
    """``screened`` for papers that can be scored, else the status that says why not."""
    if not criteria:
        return F.lit("screening_failed")
    return F.when(clean_text(abstract) == "", "missing_abstract").otherwise("screened")


def route_unprocessed(papers: DataFrame, criteria: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Papers to score, and finished results for those that cannot be scored."""
    routed = papers.withColumn("screening_status", route("abstract", criteria))
    eligible = routed.filter(F.col("screening_status") == "screened").drop("screening_status")
    reason = F.lit("no_criteria") if not criteria else F.col("screening_status")
    rest = routed.filter(F.col("screening_status") != "screened").withColumns({"reason": reason, **unprocessed_columns()})
    return eligible, rest


def unprocessed_columns() -> dict[str, Column]:
    return {
        "decision": F.lit(None).cast("string"), "decision_confidence": F.lit(None).cast("double"),
        "review_group": F.lit("needs_processing"), "group_rank": F.lit(4), "blocking_count": F.lit(0),
        "score_gap": F.lit(None).cast("double")}


def pair_papers_criteria(papers: DataFrame, criteria: list[dict], overrides: dict[str, float] | None = None,
                         default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Every paper with every criterion: a narrow explode of the criteria literal, not a join."""
    return papers.withColumn("_c", F.explode(criteria_array(criteria, overrides, default))).select(
        *papers.columns, "_c.*")


def score_pairs(pairs: DataFrame, scorer: PairScorer, logits: bool = False, limit: int | None = None,
                counter: Callable[[Column], Column] = token_count) -> DataFrame:
    """Three class scores per pair. Pairs above ``limit`` tokens keep null scores and are never truncated."""
    text = premise("title", "abstract")
    if limit is not None:
        tokens = counter(text) + counter(F.col("statement"))
        pairs = pairs.withColumns({"token_count": tokens, "token_limit": F.lit(limit),
                                   "excess_tokens": F.greatest(tokens - limit, F.lit(0))})
        text = F.when(F.col("token_count") <= limit, text)
    scores = scorer.score(text, F.col("statement"))
    scored = pairs.withColumn("_s", softmax(scores) if logits else scores)
    return scored.withColumns({name: F.col("_s")[i] for i, name in enumerate(CLASSES)}).drop("_s")


def flag_overlong(pairs: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Pairs of papers that fit, and one row with the issue list for each paper that does not."""
    over = F.col("excess_tokens") > 0
    issues = (pairs.filter(over).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "ord", F.col("label").alias("criterion"), "token_count", "token_limit", "excess_tokens"))).alias("input_issues"))
        .withColumns({"screening_status": F.lit("input_too_long"), "reason": F.lit("input_too_long")}))
    return pairs.join(issues.select(*keys), keys, "left_anti"), issues


def valid_scores(e: Column, c: Column, n: Column) -> Column:
    """Each score in [0, 1] and their sum within tolerance of 1; null or NaN is invalid."""
    each = [F.coalesce(x.between(0, 1) & ~F.isnan(x), F.lit(False)) for x in (e, c, n)]
    total = F.coalesce(F.abs(e + c + n - 1.0) <= SCORE_SUM_TOLERANCE, F.lit(False))
    return each[0] & each[1] & each[2] & total


def check_scores(scored: DataFrame, expected: int, keys: list[str] = KEYS) -> DataFrame:
    """Papers whose scores are out of range, do not sum to 1, or are not one per criterion."""
    ok = valid_scores(*(F.col(name).cast("double") for name in CLASSES))
    per_paper = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("invalid"))
    return per_paper.filter((F.col("n") != expected) | (F.col("invalid") > 0)).select(
        *keys, F.lit("screening_failed").alias("screening_status"),
        F.when(F.col("n") != expected, "invalid_classifier_response").otherwise("invalid_classifier_scores").alias("reason"))


# --- end to end ------------------------------------------------------------------------------

def screen_classifier(papers: DataFrame, criteria: list[dict], scorer: PairScorer | Callable[[dict], Column], *,
                      logits: bool = False, limit: int | None = None, counter: Callable[[Column], Column] = token_count,
                      overrides: dict[str, float] | None = None, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Screen every paper and return every paper once, in one map-only stage.

    ``scorer`` is a :class:`PairScorer` or a function from a criterion dict (with its ``ord``) to a
    Column holding three scores, for scores that are already columns or built-in expressions.
    """
    base = papers.columns
    if not criteria:
        return papers.withColumns({
            "screening_status": F.lit("screening_failed"), "reason": F.lit("no_criteria"), **unprocessed_columns(),
            "input_issues": F.array().cast("array<struct<criterion:string,token_count:int,token_limit:int,excess_tokens:int>>")})
    statements = [c["statement"] for c in criteria]
    text = premise("title", "abstract")
    df = papers.withColumn("_route", route("abstract", criteria))
    df = df.withColumn("_text", F.when(F.col("_route") == "screened", text))
    if limit is None:
        df = df.withColumn("_tokens", F.array(*[F.lit(0) for _ in criteria]))
        limit = 0
    else:
        df = df.withColumn("_paper_tokens", counter(F.col("_text")))
        df = df.withColumn("_tokens", F.array(*[F.col("_paper_tokens") + counter(F.lit(s)) for s in statements]))
    df = df.withColumn("_skip", F.transform("_tokens", lambda t: t > limit))
    labels = F.array(*[F.lit(c["label"]) for c in criteria])
    df = df.withColumn("input_issues", F.when(F.col("_text").isNull(), F.array()).otherwise(F.filter(
        F.zip_with(labels, "_tokens", lambda label, t: F.struct(
            label.alias("criterion"), t.alias("token_count"), F.lit(limit).alias("token_limit"),
            (t - limit).alias("excess_tokens"))), lambda x: x["excess_tokens"] > 0)))
    if isinstance(scorer, PairScorer):
        raw = scorer.score_each(F.col("_text"), statements, F.col("_skip"))
        scores = F.transform(raw, softmax) if logits else raw
    else:
        scores = F.array(*[scorer({**c, "ord": i}) for i, c in enumerate(criteria)])
    df = df.withColumn("_scores", scores)
    df = df.withColumn("_valid", F.forall("_scores", lambda s: valid_scores(s[0], s[1], s[2])))
    df = df.withColumn("_status", F.when(F.col("_route") != "screened", F.col("_route"))
                       .when(F.size("input_issues") > 0, "input_too_long")
                       .when(~F.coalesce("_valid", F.lit(False)), "screening_failed").otherwise("screened"))
    scored = F.zip_with(criteria_array(criteria, overrides, default), "_scores", lambda c, s: outcome_struct(
        c.withField("entailment", s[0]).withField("contradiction", s[1]).withField("neutral", s[2])))
    df = decide(compute_once(df, {"_status": F.col("_status"), "input_issues": F.col("input_issues"),
                                  "criteria": F.when(F.col("_status") == "screened", scored)}))
    unscored = F.when(F.col("_status") == "screening_failed", "invalid_classifier_scores").otherwise(F.col("_status"))
    return df.select(
        *base, F.col("_status").alias("screening_status"), F.coalesce("reason", unscored).alias("reason"), "decision",
        "decision_confidence", "review_group", "group_rank", "blocking_count", "score_gap", "input_issues",
        F.coalesce("criteria", F.array().cast(df.schema["criteria"].dataType)).alias("criteria"))


def decide(df: DataFrame) -> DataFrame:
    """Add decision and review-order columns from ``criteria``; a null array means not processed."""
    df = df.withColumn("_d", F.when(F.col("criteria").isNotNull(), aggregate_criteria(F.col("criteria"))))
    df = df.withColumn("_o", F.when(F.col("criteria").isNotNull(), review_order(F.col("criteria"), F.col("_d")["decision"])))
    return compute_once(df, {
        "decision": F.col("_d")["decision"], "reason": F.col("_d")["reason"],
        "decision_confidence": F.col("_d")["decision_confidence"],
        "review_group": F.coalesce(F.col("_o")["review_group"], F.lit("needs_processing")),
        "group_rank": F.coalesce(F.col("_o")["group_rank"], F.lit(4)),
        "blocking_count": F.coalesce(F.col("_o")["blocking_count"], F.lit(0)),
        "score_gap": F.col("_o")["score_gap"]}).drop("_d", "_o")


def failure_summary(results: DataFrame) -> DataFrame:
    """How many papers failed, of how many, and the first failing row with its reason."""
    failed = F.col("screening_status").isin("screening_failed", "output_too_long")
    position = F.when(failed, F.struct("batch_id", "row"))
    return results.agg(
        F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("papers"),
        F.min(position)["row"].alias("first_row"), F.min_by("reason", position).alias("first_reason"))


def long_criteria(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per paper and criterion result."""
    kept = KEYS + (keep or [])
    return results.select(*kept, F.explode("criteria").alias("_c")).select(*kept, "_c.*")
