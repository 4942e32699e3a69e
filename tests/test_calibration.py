import random

from pyspark.sql import functions as F

from citesieve.operators import calibration as c


def brute(items, current, limit):
    scores = [s for s, _ in items]
    edges = sorted({0.5, 1.0} | {s for s in scores if 0.5 <= s <= 1})
    best = None
    for t in {0.5, 1.0, current} | {(a + b) / 2 for a, b in zip(edges, edges[1:])}:
        accepted = sum(s >= t for s in scores)
        wrong = sum(e for s, e in items if s >= t)
        if accepted and wrong / accepted <= limit:
            key = (-accepted, wrong, abs(t - current), t)
            best = min(best or key, key)
    return best and (best[3], -best[0], best[1])


def test_sweep_equals_brute_force(spark):
    rng = random.Random(7)
    groups, rows = {}, []
    for g in range(40):
        n = rng.randrange(1, 25)
        items = [(rng.choice([0.34, 0.5, 1.0, round(rng.uniform(0.34, 1), 2)]), rng.random() < 0.4) for _ in range(n)]
        groups[f"g{g}"] = (items, rng.choice([0.5, 0.8, 0.83]))
        rows += [(f"g{g}", s, e) for s, e in items]
    df = spark.createDataFrame(rows, "label string, score double, error boolean")
    for limit in (0.0, 0.3):
        got = {x.label: (x.threshold, x.accepted, x.disagreements) for x in c.best_threshold(
            df, {g: t for g, (_, t) in groups.items()}, limit).collect()}
        for g, (items, current) in groups.items():
            assert got.get(g) == brute(items, current, limit), (g, limit)


def test_stability(spark):
    rows = [("a", "b", i, 0.5 + (i % 50) / 100, i % 9 == 0, "entailment" if i % 2 else "neutral") for i in range(60)]
    df = spark.createDataFrame(rows, "label string, batch_id string, row long, score double, error boolean, reviewer_class string")
    cfg = c.CalibrationConfig(bootstrap_enabled=True, bootstrap_samples=10, max_disagreement_rate=0.5)
    one = c.threshold_stability(df, {"a": 0.8, "none": 0.8}, cfg).orderBy("label").collect()
    two = c.threshold_stability(df.repartition(5), {"a": 0.8, "none": 0.8}, cfg).orderBy("label").collect()
    assert one == two and one[0].samples == 10 and one[0].lower <= one[0].upper and one[1].stability == "insufficient_reviews"
    off = c.threshold_stability(df, {"a": 0.8}, c.CalibrationConfig()).first()
    assert off.stability == "disabled"
    strict = c.CalibrationConfig(bootstrap_enabled=True, bootstrap_samples=5, max_disagreement_rate=0.0)
    bad = c.threshold_stability(df.withColumn("error", F.lit(True)), {"a": 0.8}, strict).first()
    assert bad.stability == "no_feasible_resamples"


def test_calibrate_states(spark):
    schema = ("batch_id string, row long, screening_status string, criteria array<struct<label:string,type:string,entailment:double,"
              "contradiction:double,neutral:double,human_finding:string,human_decision:string,explicit_evidence_required:boolean>>")
    rows = [("b", 1, "screened", [("ok", "include", .9, .05, .05, None, "passed", False), ("never", "include", .9, .05, .05, None, "failed", False),
                                  ("unseen", "include", .9, .05, .05, None, None, False), ("explicit", "include", .1, .8, .1, None, "failed", True)]),
            ("b", 2, "missing_abstract", [])]
    report = c.calibrate(spark.createDataFrame(rows, schema), {"ok": 0.8, "never": 0.8, "unseen": 0.8, "explicit": 0.8, "absent": 0.7})
    got = {x.label: (x.tuning_status, x.ready, x.reviewed) for x in report.collect()}
    assert got == {"ok": ("suggested", True, 1), "never": ("no_feasible_threshold", False, 1), "unseen": ("no_reviews", False, 0),
                   "explicit": ("no_reviews", False, 0), "absent": ("no_reviews", False, 0)}
    totals = {x.which: (x.ready, x.reviewed, x.accepted) for x in c.calibration_totals(report).collect()}
    assert totals == {"current": (False, 2, 2), "suggested": (False, 2, 2)}
