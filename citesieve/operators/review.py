"""Human labels, agreement and reclassification under new thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.session import literal_rows
from citesieve.operators.screening import (CLASSES, DECISIONS, DEFAULT_THRESHOLD, KEYS, decide, outcome_struct,
                                           threshold_column)

# Fixed values.
STOCK_REASONS = ["llm_paper_decision", "all_criteria_passed"]
INCLUDE_DECISIONS = ["passed", "failed", "unresolved"]
EXCLUDE_DECISIONS = ["hit", "cleared", "unresolved"]

DEFINITION = ["label", "statement", "type", "explicit_evidence_required"]


def latest_paper_labels(events: DataFrame, panel_papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Last label per paper (a null decision clears it), and the events refused because a panel owns the paper.

    ``max_by`` combines on the map side, so a paper with very many events is not a hot task.
    """
    refused = events.limit(0)
    if panel_papers is not None:
        owned = panel_papers.select(*KEYS).distinct()
        refused = events.join(owned, KEYS, "left_semi")
        events = events.join(owned, KEYS, "left_anti")
    last = F.max_by(F.struct("decision", "ts"), F.struct("ts", "event_id"))
    labels = events.groupBy(*KEYS).agg(last.alias("_l")).select(
        *KEYS, F.col("_l.decision").alias("human_decision"),
        F.when(F.col("_l.decision").isNotNull(), F.col("_l.ts")).alias("human_labelled_at"))
    return labels, refused.withColumn("reject_reason", F.lit("panel_paper"))


def label_error(kind: Column, finding: Column, decision: Column) -> Column:
    """Why a criterion label is refused, or null: wrong for the criterion type, or against the finding."""
    include = kind == "include"
    fits = F.when(include, decision.isin(*INCLUDE_DECISIONS)).otherwise(decision.isin(*EXCLUDE_DECISIONS))
    expected = (F.when(finding == "supported", F.when(include, "passed").otherwise("hit"))
                .when(finding == "contradicted", F.when(include, "failed").otherwise("cleared")).otherwise("unresolved"))
    return (F.when(decision.isNotNull() & ~fits, "decision_not_valid_for_type")
            .when(finding.isNotNull() & ~decision.eqNullSafe(expected), "finding_and_decision_differ"))


def latest_criterion_labels(events: DataFrame, results: DataFrame, criteria: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Last accepted label per paper and criterion, and the refused events.

    Type rules need only the criteria list. Whether the paper has the criterion is one join with
    the results on the paper key, made after the rules, with the results side unique per key.
    """
    kinds = F.array(*[F.lit(c["type"]) for c in criteria])
    known = F.col("ord").between(0, len(criteria) - 1)
    kind = F.get(kinds, F.col("ord"))
    sizes = results.select(*KEYS, F.size("criteria").alias("_size"))
    judged = events.join(sizes, KEYS, "left").withColumn("reject_reason", (
        F.when(F.col("_size").isNull(), "paper_not_found")
        .when(~known | (F.col("ord") >= F.col("_size")), "criterion_not_found")
        .otherwise(label_error(kind, F.col("human_finding"), F.col("human_decision"))))).drop("_size")
    last = F.max_by(F.struct("human_finding", "human_decision", "ts"), F.struct("ts", "event_id"))
    labels = judged.filter("reject_reason IS NULL").groupBy(*KEYS, "ord").agg(last.alias("_l")).select(
        *KEYS, "ord", "_l.human_finding", "_l.human_decision",
        F.when(F.col("_l.human_decision").isNotNull(), F.col("_l.ts")).alias("human_labelled_at"))
    return labels, judged.filter("reject_reason IS NOT NULL")


def with_criterion_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Put criterion labels (at most one per criterion) into the ``criteria`` arrays of the results."""
    per_paper = labels.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct(
        "ord", F.struct("human_finding", "human_decision", "human_labelled_at")))).alias("_labels"))
    joined = results.join(per_paper, KEYS, "left")

    def labelled(c: Column) -> Column:
        mine = F.element_at("_labels", c["ord"])
        return (c.withField("human_finding", mine["human_finding"]).withField("human_decision", mine["human_decision"])
                .withField("human_labelled_at", mine["human_labelled_at"]))

    return joined.withColumn("criteria", F.transform("criteria", labelled)).drop("_labels")


def _same_definition(a: Column, b: Column) -> Column:
    same = F.lit(True)
    for name in DEFINITION:
        same = same & a[name].eqNullSafe(b[name])
    return same


def carry_labels(new: DataFrame, prior: DataFrame) -> DataFrame:
    """Labels of an earlier run on a new run: by paper, and by criterion where its definition is unchanged."""
    old = prior.select(*KEYS, F.col("human_decision").alias("_decision"), F.col("human_labelled_at").alias("_at"),
                       F.col("criteria").alias("_old"))

    def labelled(c: Column) -> Column:
        matches = F.filter("_old", lambda o: _same_definition(c, o))
        mine = F.get(matches, F.size(matches) - 1)
        return (c.withField("human_decision", mine["human_decision"]).withField("human_finding", mine["human_finding"])
                .withField("human_labelled_at", mine["human_labelled_at"]))

    return (new.join(old, KEYS, "left").withColumns({
        "human_decision": F.col("_decision"), "human_labelled_at": F.col("_at"),
        "criteria": F.transform("criteria", labelled)}).drop("_decision", "_at", "_old"))


def stale_reviews(prior: DataFrame, criteria: list[dict], history: DataFrame | None = None) -> DataFrame:
    """Review history with the labelled criterion results whose definition no longer exists, each once."""
    rows = prior.select(*KEYS, F.explode("criteria").alias("_c")).filter(F.col("_c.human_decision").isNotNull())
    current = F.lit(False)
    for c in criteria:
        wanted = {**c, "explicit_evidence_required": bool(c.get("explicit_evidence_required", False))}
        same = F.lit(True)
        for name in DEFINITION:
            same = same & F.col(f"_c.{name}").eqNullSafe(F.lit(wanted[name]))
        current = current | same
    stale = rows.filter(~current).select(*KEYS, "_c.*")
    return (stale if history is None else history.unionByName(stale)).dropDuplicates()


def agreement(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviewed, agreeing, rate) and the full human x machine table with zeros, as long rows."""
    spark = results.sparkSession
    counted = (results.filter(F.col("human_decision").isNotNull() & F.col("decision").isin(*DECISIONS))
               .groupBy(F.col("human_decision").alias("human"), F.col("decision").alias("machine"))
               .agg(F.count(F.lit(1)).alias("n")))
    grid = literal_rows(spark, [{"human": h, "machine": m} for h in DECISIONS for m in DECISIONS],
                        "human STRING, machine STRING")
    confusion = (grid.join(counted, ["human", "machine"], "left")
                 .select("human", "machine", F.coalesce("n", F.lit(0)).alias("n")))
    agreeing = F.sum(F.when(F.col("human") == F.col("machine"), F.col("n")).otherwise(0))
    totals = confusion.agg(F.sum("n").alias("reviewed"), agreeing.alias("agreeing")).withColumn(
        "agreement_rate", F.col("agreeing") / F.nullif(F.col("reviewed"), F.lit(0)))
    return totals, confusion


def reclassify(results: DataFrame, thresholds: dict[str, float], default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Recompute findings, decisions and review order from stored scores; unscreened papers pass through. Map-only."""
    redo = (F.col("screening_status") == "screened") & (F.size("criteria") > 0)
    changed = ["decision", "reason", "decision_confidence", "review_group", "group_rank", "blocking_count", "score_gap"]
    rescored = results.withColumns({f"_old_{c}": F.col(c) for c in changed}).withColumn("_kept", F.col("criteria"))
    rescored = rescored.withColumn("criteria", F.when(redo, F.transform("criteria", lambda c: outcome_struct(
        c, threshold_column(c["label"], c["confidence_threshold"], thresholds, default)))))
    decided = decide(rescored)
    return decided.withColumns({
        **{c: F.when(redo, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in changed},
        "criteria": F.coalesce("criteria", "_kept")}).select(*results.columns)


def refuse_reclassify(results: DataFrame) -> DataFrame:
    """Papers that forbid a reclassification of their batch: model-completed or panel-managed ones."""
    reasons = []
    if "backend" in results.columns:
        reasons.append(F.when(F.col("backend") == "llm", "completion_results"))
    if "consensus_status" in results.columns:
        reasons.append(F.when(F.col("consensus_status").isNotNull(), "panel_managed"))
    if not reasons:
        return results.limit(0).select(*KEYS, F.lit("").alias("reject_reason"))
    return results.select(*KEYS, F.coalesce(*reasons).alias("reject_reason")).filter("reject_reason IS NOT NULL")


def check_thresholds(requests: DataFrame, criteria: list[dict]) -> DataFrame:
    """Requested thresholds (label, threshold) with an unknown label or a value outside [0.5, 1]."""
    labels = [c["label"] for c in criteria]
    problem = (F.when(~F.col("label").isin(*labels), "unknown_label")
               .when(~F.coalesce(F.col("threshold").between(0.5, 1.0), F.lit(False)), "outside_range"))
    return requests.withColumn("reject_reason", problem).filter("reject_reason IS NOT NULL")


def useful_reason(model_reason, machine_reason) -> Column:
    """The model's reason, else the machine reason unless it is a stock code."""
    machine = F.col(machine_reason) if isinstance(machine_reason, str) else machine_reason
    own = F.col(model_reason) if isinstance(model_reason, str) else model_reason
    return F.coalesce(F.nullif(own, F.lit("")), F.when(~machine.isin(*STOCK_REASONS), machine))


def estimate_calls(papers: DataFrame, n_criteria: int, backend: str = "llm", mode: str = "per_criterion",
                   second_reviewer: str | None = None, judge: str | None = None) -> DataFrame:
    """Fewest and most model calls per batch; roles are ``human``, ``llm`` or None. A judge may not be needed."""
    per_paper = (n_criteria if mode == "per_criterion" else 1) if backend == "llm" else 0
    least = per_paper + (second_reviewer == "llm")
    return papers.groupBy("batch_id").agg(F.count(F.lit(1)).alias("papers")).select(
        "batch_id", "papers", (F.col("papers") * least).alias("minimum_calls"),
        (F.col("papers") * (least + (judge == "llm"))).alias("maximum_calls"))


def batch_summary(citations: DataFrame, results: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Per batch: file name when given, number of papers, and whether results exist."""
    counts = citations.groupBy("batch_id").agg(F.count(F.lit(1)).alias("paper_count"))
    done = results.select("batch_id").distinct().withColumn("has_results", F.lit(True))
    summary = counts.join(done, "batch_id", "left").withColumn("has_results", F.coalesce("has_results", F.lit(False)))
    if batches is not None:
        summary = summary.join(batches.select("batch_id", "filename"), "batch_id", "left")
    return summary


# What stored results may hold.
ALLOWED = {
    "screening_status": ["screened", "missing_abstract", "screening_failed", "input_too_long", "output_too_long"],
    "decision": DECISIONS,
    "human_decision": DECISIONS,
    "review_group": ["uncertain", "missing_evidence", "confirm_inclusion_gaps", "optional_check", "needs_processing"],
    "backend": ["nli", "llm"],
}
ALLOWED_CRITERION = {
    "type": ["include", "exclude"],
    "status": CLASSES,
    "finding": ["supported", "contradicted", "not_established", "uncertain"],
    "human_finding": ["supported", "contradicted", "not_established", "uncertain"],
    "criterion_decision": ["passed", "failed", "cleared", "hit", "unresolved"],
    "human_decision": ["passed", "failed", "cleared", "hit", "unresolved"],
}
REQUIRED = {"screening_status", "review_group"}


def _outside(name: str, values: list[str], required: bool):
    return lambda c: F.coalesce(~c[name].isin(*values), F.lit(required))


def validate_results(results: DataFrame) -> DataFrame:
    """Stored results that break the schema: rejected rows with the list of broken rules."""
    have = results.columns
    rules = [F.when(~F.coalesce(F.col("row") >= 1, F.lit(False)), "row")]
    for name, values in ALLOWED.items():
        if name in have:
            bad = ~F.col(name).isin(*values)
            rules.append(F.when(F.coalesce(bad, F.lit(name in REQUIRED)), name))
    for name, low, high in [("group_rank", 0, 4), ("blocking_count", 0, None), ("score_gap", 0, 1)]:
        if name in have:
            value = F.col(name)
            bad = (value < low) if high is None else ~value.between(low, high)
            rules.append(F.when(F.coalesce(bad, F.lit(name != "score_gap")), name))
    for name in ["reason", "title", "abstract"]:
        if name in have:
            rules.append(F.when(F.col(name).isNull(), name))
    if "criteria" in have:
        fields = results.schema["criteria"].dataType.elementType.fieldNames()
        for name, values in ALLOWED_CRITERION.items():
            if name in fields:
                required = name in ("type", "criterion_decision")
                rules.append(F.when(F.exists("criteria", _outside(name, values, required)), f"criteria.{name}"))
        if "confidence_threshold" in fields:
            rules.append(F.when(F.exists("criteria", lambda c: F.coalesce(
                ~c["confidence_threshold"].between(0.5, 1.0), F.lit(False))), "criteria.confidence_threshold"))
    broken = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return results.withColumn("violations", broken).filter(F.size("violations") > 0)


