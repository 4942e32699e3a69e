import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citesieve.functions.models import PairScorer
from citesieve.operators import review as r
from citesieve.operators import screening as s

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CRITERIA = [
    {"label": "I1", "statement": "s1", "type": "include", "confidence_threshold": 0.6},
    {"label": "I2", "statement": "s2 x", "type": "include", "explicit_evidence_required": True},
    {"label": "E1", "statement": "s3", "type": "exclude", "confidence_threshold": 0.6},
]
YES, NO, NEUTRAL, WEAK = [0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.4, 0.35, 0.25]


def papers(spark, scores):
    rows = [("b", i + 1, "T", "A", [list(map(float, x)) for x in sc]) for i, sc in enumerate(scores)]
    return spark.createDataFrame(rows, "batch_id string, row long, title string, abstract string, sc array<array<double>>")


@pytest.mark.parametrize("scores, decision, reason, confidence, group, blocking", [
    ([YES, YES, NO], "Include", "all_criteria_passed", 0.9, "optional_check", 0),
    ([NO, YES, NO], "Exclude", "criterion_failed:I1", 0.9, "optional_check", 0),
    ([YES, NEUTRAL, YES], "Exclude", "criterion_failed:I2, E1", 0.9, "optional_check", 0),
    ([NEUTRAL, YES, NO], "Likely include", "unresolved_criteria:I1", None, "confirm_inclusion_gaps", 0),
    ([WEAK, YES, NO], "Maybe", "unresolved_criteria:I1", None, "uncertain", 1),
    ([NEUTRAL, YES, NEUTRAL], "Maybe", "unresolved_criteria:I1, E1", None, "missing_evidence", 2),
    ([YES, YES, WEAK], "Maybe", "unresolved_criteria:E1", None, "uncertain", 1),
])
def test_decisions(spark, scores, decision, reason, confidence, group, blocking):
    out = s.screen_classifier(papers(spark, [scores]), CRITERIA, lambda c: F.get("sc", F.lit(c["ord"]))).first()
    assert (out.decision, out.reason, out.decision_confidence, out.review_group, out.blocking_count) == (
        decision, reason, confidence, group, blocking)
    long = s.with_outcome(s.pair_papers_criteria(papers(spark, [scores]), CRITERIA).withColumns(
        {n: F.get("sc", F.col("ord"))[i] for i, n in enumerate(s.CLASSES)}))
    again = s.aggregate_paper(long).first()
    assert (again.decision, again.reason, again.decision_confidence) == (decision, reason, confidence)


def test_only_excludes_never_include(spark):
    out = s.screen_classifier(papers(spark, [[NO]]), CRITERIA[2:], lambda c: F.get("sc", F.lit(0))).first()
    assert out.decision == "Maybe" and out.reason == "unresolved_criteria:"


def test_ties_and_gap(spark):
    out = s.screen_classifier(papers(spark, [[[0.4, 0.4, 0.2], YES, NO]]), CRITERIA, lambda c: F.get("sc", F.lit(c["ord"]))).first()
    assert out.criteria[0].status == "entailment" and out.score_gap == 0.0


def model():
    return lambda a, b: np.array([[len(y), 0.0, 0.0] for y in b])


def test_pair_scorer_logits_and_limits(spark):
    df = papers(spark, [[YES]] * 3).withColumn("abstract", F.when(F.col("row") == 2, "  ").when(
        F.col("row") == 3, F.repeat(F.lit("w "), 50)).otherwise("A"))
    out = {x.row: x for x in s.screen_classifier(df, CRITERIA, PairScorer(model), logits=True, limit=10).collect()}
    assert len(out) == 3
    assert out[1].screening_status == "screened" and abs(out[1].criteria[0].entailment - np.e**2 / (np.e**2 + 2)) < 1e-9
    assert out[2].screening_status == "missing_abstract" and out[2].group_rank == 4 and out[2].criteria == []
    assert out[3].screening_status == "input_too_long" and len(out[3].input_issues) == 3
    assert out[3].input_issues[1].excess_tokens == out[3].input_issues[1].token_count - 10


def test_invalid_scores_and_no_criteria(spark):
    df = papers(spark, [[[0.9, 0.3, 0.1], YES, NO], [[float("nan"), 0.5, 0.5], YES, NO], [[0.5, 0.25, 0.25005], YES, NO]])
    out = [x.screening_status for x in s.screen_classifier(df, CRITERIA, lambda c: F.get("sc", F.lit(c["ord"]))).orderBy("row").collect()]
    assert out == ["screening_failed", "screening_failed", "screened"]
    none = s.screen_classifier(df, [], model).first()
    assert (none.screening_status, none.reason) == ("screening_failed", "no_criteria")


def test_filter_does_not_repeat_scoring(spark):
    df = s.screen_classifier(papers(spark, [[YES, YES, NO]]), CRITERIA, lambda c: F.get("sc", F.lit(c["ord"]))).filter("decision = 'Include'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000 and df.count() == 1


def test_screening_is_map_only(spark):
    df = s.screen_classifier(papers(spark, [[YES, YES, NO]]), CRITERIA, lambda c: F.get("sc", F.lit(c["ord"])))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_reclassify_and_carry(spark):
    df = papers(spark, [[WEAK, YES, NO], [YES, YES, NO]])
    out = s.screen_classifier(df, CRITERIA, lambda c: F.get("sc", F.lit(c["ord"])))
    changed = {x.row: x for x in r.reclassify(out, {"I1": 0.4, "I2": 0.95}).collect()}
    assert changed[1].criteria[0].criterion_decision == "passed" and changed[1].criteria[1].criterion_decision == "unresolved"
    assert changed[2].decision == "Maybe"
    assert r.refuse_reclassify(out.withColumn("backend", F.lit("llm"))).count() == 2
    assert s.failure_summary(out).first().failed == 0


def test_label_rules(spark):
    rows = [("include", "supported", "passed"), ("include", "supported", "failed"), ("exclude", None, "passed"), ("exclude", "uncertain", "unresolved"),
            ("include", None, None), ("exclude", "contradicted", None)]
    df = spark.createDataFrame(rows, "t string, f string, d string")
    got = [x[0] for x in df.select(r.label_error(F.col("t"), F.col("f"), F.col("d"))).collect()]
    assert got == [None, "finding_and_decision_differ", "decision_not_valid_for_type", None, None, "finding_and_decision_differ"]
