"""Threshold calibration against reviewer labels.

The sweep never compares every candidate with every item: equal scores are counted first, then
suffix sums over the distinct scores give the accepted and wrong predictions of every candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.functions.ordered import dense_index, suffix_sums
from citesieve.operators.screening import KEYS, argmax_label
from citesieve.session import literal_rows, shared

# Width of the score buckets of the sweep: single-precision class scores have at most 1024 values in one.
SCORE_BUCKETS = 1 << 14


@dataclass(frozen=True)
class CalibrationConfig:
    diagnostic_min_papers: int = 10
    neutral_rate_threshold: float = 0.5
    uncertain_rate_threshold: float = 0.3
    min_reviews: int = 20
    max_disagreement_rate: float = 0.0
    bootstrap_enabled: bool = False
    bootstrap_samples: int = 100
    random_seed: int = 0
    max_threshold_spread: float = 0.1


def reviewer_class(human_finding: Column, human_decision: Column, explicit: Column) -> Column:
    """The class a reviewer's label stands for; null when it stands for none."""
    from_finding = (F.when(human_finding == "supported", "entailment").when(human_finding == "contradicted", "contradiction")
                    .when(human_finding == "not_established", "neutral"))
    from_decision = (F.when(F.coalesce(explicit, F.lit(False)) & (human_decision == "failed"), F.lit(None))
                     .when(human_decision.isin("passed", "hit"), "entailment")
                     .when(human_decision.isin("failed", "cleared"), "contradiction")
                     .when(human_decision == "unresolved", "neutral"))
    return F.when(F.coalesce(human_finding, F.lit("")) != "", from_finding).otherwise(from_decision)


def criterion_items(results: DataFrame) -> DataFrame:
    """Every criterion result of the screened papers with its score, model class and reviewer class."""
    long = (results.filter(F.coalesce(F.col("screening_status"), F.lit("screened")) == "screened")
            .select(*KEYS, F.explode("criteria").alias("_c")))
    c = {name: F.col(f"_c.{name}") for name in
         ["entailment", "contradiction", "neutral", "human_finding", "human_decision", "explicit_evidence_required"]}
    model = argmax_label(c["entailment"], c["contradiction"], c["neutral"])
    return long.select(
        *KEYS, "_c.label", "_c.type", F.greatest(c["entailment"], c["contradiction"], c["neutral"]).alias("score"),
        model.alias("model_class"),
        reviewer_class(c["human_finding"], c["human_decision"], c["explicit_evidence_required"]).alias("reviewer_class"))


def labelled_items(results: DataFrame) -> DataFrame:
    """Items with a reviewer class, and whether the model disagrees (``error``)."""
    return with_error(criterion_items(results))


def threshold_map(thresholds: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in thresholds.items() for x in (pair[0], float(pair[1]))])


def with_current(items: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Attach the threshold in force by label, from configuration; items of other labels are not part of the run."""
    return items.withColumn("current", F.element_at(threshold_map(thresholds), F.col("label"))).filter(
        F.col("current").isNotNull())


def item_count(items: DataFrame) -> Column:
    """Weight of an item row: ``n`` after :func:`count_items`, else 1."""
    return F.col("n") if "n" in items.columns else F.lit(1).cast("bigint")


def count_items(items: DataFrame) -> DataFrame:
    """Equal items counted once (label, type, score, classes): all a calibration reads, made in one pass."""
    return items.groupBy("label", "type", "score", "model_class", "reviewer_class").agg(F.count(F.lit(1)).alias("n"))


def with_error(items: DataFrame) -> DataFrame:
    """Items with a reviewer class, and whether the model disagrees (``error``)."""
    return items.filter(F.col("reviewer_class").isNotNull()).withColumn("error", F.col("model_class") != F.col("reviewer_class"))


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "agreements": F.col("accepted") - F.col("disagreements"), "uncertain": F.col("reviewed") - F.col("accepted"),
        "coverage": F.col("accepted") / F.nullif(F.col("reviewed"), F.lit(0)),
        "disagreement_rate": F.col("disagreements") / F.nullif(F.col("accepted"), F.lit(0))})


def threshold_metrics(items: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Reviewed, accepted, wrong and uncertain predictions per label at the given thresholds."""
    used = with_current(items, thresholds)
    accepted, n = F.col("score") >= F.col("current"), item_count(items)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return _rates(used.groupBy("label").agg(
        F.first("current").alias("threshold"), F.sum(n).alias("reviewed"), total(accepted).alias("accepted"),
        total(accepted & F.col("error")).alias("disagreements")))


def _score_counts(items: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Items and errors per distinct score: all the sweep reads, and small against the items."""
    return shared(items.groupBy(*by, "current", "score").agg(
        F.sum(weight).alias("n"), F.sum(F.when(F.col("error"), weight).otherwise(0)).alias("errors")))


def _sweep(counted: DataFrame, by: list[str]) -> DataFrame:
    """Candidate thresholds with accepted items and errors, from per-score counts."""
    keys = [*by, "current"]
    edges = counted.select(*keys).distinct().select(
        "*", F.explode(F.array(F.lit(0.5), F.lit(1.0))).alias("score"), F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("errors"))
    bounded = (counted.filter(F.col("score").between(0.5, 1.0)).unionByName(edges).groupBy(*keys, "score")
               .agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")))
    bucket = F.floor((F.col("score") - 0.5) * (2 * SCORE_BUCKETS)).cast("int")
    suffix = suffix_sums(bounded, keys, "score", bucket, {"n": "at_least", "errors": "wrong_at_least"})
    middle = (F.col("score") + F.col("next_score")) / 2
    # A midpoint accepts from the next score on, unless rounding puts it on the lower one.
    lower = middle <= F.col("score")
    middles = suffix.filter(F.col("next_score").isNotNull()).select(
        *keys, middle.alias("threshold"),
        F.when(lower, F.col("at_least")).otherwise(F.col("at_least") - F.col("n")).alias("accepted"),
        F.when(lower, F.col("wrong_at_least")).otherwise(F.col("wrong_at_least") - F.col("errors")).alias("disagreements"))
    fixed = counted.withColumn("threshold", F.explode(F.array_distinct(F.array(F.lit(0.5), F.lit(1.0), F.col("current")))))
    kept = F.col("score") >= F.col("threshold")
    points = fixed.groupBy(*keys, "threshold").agg(
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(kept, F.col("errors")).otherwise(0)).alias("disagreements"))
    return middles.unionByName(points)


def candidate_thresholds(items: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """0.5, 1, the current threshold and the midpoints between neighbouring scores, per label."""
    counted = _score_counts(with_current(items, thresholds), ["label"], item_count(items))
    return _sweep(counted, ["label"]).select("label", "threshold").distinct()


def best_threshold(items: DataFrame, thresholds: dict[str, float], max_disagreement_rate: float = 0.0) -> DataFrame:
    """Per label: the candidate that accepts most within the disagreement limit. Labels with none are absent."""
    used = with_current(items, thresholds)
    return _best(_score_counts(used, ["label"], item_count(items)), ["label"], max_disagreement_rate)


def _best(counted: DataFrame, by: list[str], max_disagreement_rate: float) -> DataFrame:
    feasible = _sweep(counted, by).filter(
        (F.col("accepted") > 0) & (F.col("disagreements") / F.col("accepted") <= max_disagreement_rate))
    key = F.struct((-F.col("accepted")).alias("a"), F.col("disagreements").alias("e"),
                   F.abs(F.col("threshold") - F.col("current")).alias("d"), F.col("threshold").alias("t"))
    chosen = feasible.groupBy(*by).agg(F.min(key).alias("_k"))
    reviewed = counted.groupBy(*by).agg(F.sum("n").alias("reviewed"))
    return _rates(chosen.join(reviewed, by).select(
        *by, F.col("_k.t").alias("threshold"), "reviewed", (-F.col("_k.a")).alias("accepted"),
        F.col("_k.e").alias("disagreements")))


def threshold_stability(items: DataFrame, thresholds: dict[str, float], cfg: CalibrationConfig) -> DataFrame:
    """Spread of the best threshold over stratified resamples, per label.

    Each replicate draws, in every reviewer class, as many items as the class has. A draw is a hash
    of (seed, label, replicate, class, position), so the result does not depend on partitioning.
    """
    spark = items.sparkSession
    labels = literal_rows(spark, [{"label": k} for k in thresholds], "label STRING")
    empty = {"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double"), "samples": F.lit(0).cast("bigint")}
    if not cfg.bootstrap_enabled:
        return labels.withColumns({"stability": F.lit("disabled"), **empty})
    used = with_current(items, thresholds)
    counts = used.groupBy("label").agg(F.count(F.lit(1)).alias("n_items"))
    indexed = dense_index(used.select("label", "current", "reviewer_class", "score", "error", *KEYS),
                          ["label", "reviewer_class"], [*KEYS, "score"], "ix")
    draw = F.pmod(F.xxhash64(F.lit(cfg.random_seed), "label", "replicate", "reviewer_class", "ix"), F.col("ix_size"))
    drawn = (indexed.select("label", "reviewer_class", "ix", "ix_size",
                            F.explode(F.sequence(F.lit(0), F.lit(cfg.bootstrap_samples - 1))).alias("replicate"))
             .select("label", "reviewer_class", "replicate", draw.alias("ix"))
             .groupBy("label", "reviewer_class", "replicate", "ix").agg(F.count(F.lit(1)).alias("times")))
    sampled = drawn.join(indexed, ["label", "reviewer_class", "ix"])
    estimates = _best(_score_counts(sampled, ["label", "replicate"], F.col("times")), ["label", "replicate"],
                      cfg.max_disagreement_rate)
    spread = estimates.groupBy("label").agg(F.array_sort(F.collect_list("threshold")).alias("_t"))
    joined = labels.join(counts, "label", "left").join(spread, "label", "left")
    n = F.coalesce(F.size("_t"), F.lit(0))
    enough = F.coalesce(F.col("n_items"), F.lit(0)) >= cfg.min_reviews
    whole = enough & (F.greatest(n, F.lit(0)) == cfg.bootstrap_samples)
    low = F.when(whole, F.get("_t", F.lit(int(0.1 * (cfg.bootstrap_samples - 1)))))
    high = F.when(whole, F.get("_t", F.lit(int(0.9 * (cfg.bootstrap_samples - 1)))))
    return joined.select(
        "label", F.when(~enough, "insufficient_reviews").when(~whole, "no_feasible_resamples")
        .when(high - low <= cfg.max_threshold_spread, "stable").otherwise("unstable").alias("stability"),
        low.alias("lower"), high.alias("upper"),
        F.when(enough, F.greatest(n, F.lit(0))).otherwise(0).cast("bigint").alias("samples"))


def criterion_diagnostics(all_items: DataFrame, thresholds: dict[str, float], cfg: CalibrationConfig) -> DataFrame:
    """How often a criterion is neutral or uncertain over all its items, with flags once there are enough."""
    used, n = with_current(all_items, thresholds), item_count(all_items)
    counts = used.groupBy("label").agg(
        F.first("type", ignorenulls=True).alias("type"), F.sum(n).alias("assessed"),
        F.sum(F.when((F.col("model_class") == "neutral") & (F.col("score") >= F.col("current")), n).otherwise(0)).alias("neutral_count"),
        F.sum(F.when(F.col("score") < F.col("current"), n).otherwise(0)).alias("uncertain_count"))
    return with_flags(counts, cfg)


def with_flags(counts: DataFrame, cfg: CalibrationConfig) -> DataFrame:
    counts = counts.withColumns({
        "neutral_rate": F.col("neutral_count") / F.nullif(F.col("assessed"), F.lit(0)),
        "uncertain_rate": F.col("uncertain_count") / F.nullif(F.col("assessed"), F.lit(0)),
        "enough_papers": F.col("assessed") >= cfg.diagnostic_min_papers})
    flags = F.array(
        F.when(F.col("enough_papers") & (F.col("neutral_rate") >= cfg.neutral_rate_threshold), "frequently_neutral"),
        F.when(F.col("enough_papers") & (F.col("uncertain_rate") >= cfg.uncertain_rate_threshold), "frequently_uncertain"))
    return counts.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))


def overall_metrics(reports: DataFrame) -> DataFrame:
    """Sums of per-label metrics, with the rates recomputed."""
    return _rates(reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["reviewed", "accepted", "disagreements"]]))


def calibrate(results: DataFrame, thresholds: dict[str, float], cfg: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """One report per criterion: current and suggested threshold with their metrics, stability and diagnostics.

    ``thresholds`` are those in force by label; ``ready`` of the whole run is ``every(ready)``.
    """
    spark = results.sparkSession
    everything = shared(count_items(criterion_items(results)))
    items = with_error(everything)
    labels = literal_rows(spark, [{"position": i, "label": k, "current_threshold": float(v)}
                                  for i, (k, v) in enumerate(thresholds.items())],
                          "position INT, label STRING, current_threshold DOUBLE")
    metrics = ["reviewed", "accepted", "disagreements"]

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("label", *[F.col(c).alias(f"{prefix}_{c}") for c in ["threshold", *metrics]])

    current = prefixed(threshold_metrics(items, thresholds), "current").drop("current_threshold")
    best = prefixed(best_threshold(items, thresholds, cfg.max_disagreement_rate), "candidate")
    report = (labels.join(current, "label", "left").join(best, "label", "left")
              .join(criterion_diagnostics(everything, thresholds, cfg), "label", "left")
              .join(threshold_stability(labelled_items(results), thresholds, cfg), "label", "left"))
    counts = ["current_reviewed", "current_accepted", "current_disagreements", "assessed", "neutral_count", "uncertain_count"]
    report = report.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    report = report.withColumns({
        "ready": F.col("candidate_threshold").isNotNull(), "enough_papers": F.coalesce("enough_papers", F.lit(False)),
        "flags": F.coalesce("flags", F.array().cast("array<string>")), "reviewed": F.col("current_reviewed"),
        "tuning_status": F.when(F.col("current_reviewed") == 0, "no_reviews")
        .when(F.col("candidate_threshold").isNull(), "no_feasible_threshold").otherwise("suggested"),
        "suggested_threshold": F.coalesce("candidate_threshold", "current_threshold"),
        **{f"suggested_{c}": F.coalesce(f"candidate_{c}", f"current_{c}") for c in metrics}})
    return report.drop(*[f"candidate_{c}" for c in metrics])


def calibration_totals(report: DataFrame) -> DataFrame:
    """Current and suggested totals over all criteria, and whether every criterion is ready."""
    metrics = ["reviewed", "accepted", "disagreements"]
    sides = ["current", "suggested"]
    sums = report.agg(F.coalesce(F.every("ready"), F.lit(False)).alias("ready"), *[
        F.coalesce(F.sum(f"{side}_{m}"), F.lit(0)).alias(f"{side}_{m}") for side in sides for m in metrics])
    rows = F.array(*[F.struct(F.lit(side).alias("which"), *[F.col(f"{side}_{m}").alias(m) for m in metrics]) for side in sides])
    return _rates(sums.select("ready", F.explode(rows).alias("_r")).select("ready", "_r.*"))
