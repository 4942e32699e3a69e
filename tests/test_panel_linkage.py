import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from citesieve.operators import linkage as k
from citesieve.operators import panel as p

EVENT = "batch_id string, row long, event_id long, ts timestamp, role string, decision string, reason string, fingerprint string, kind string"


def test_resolve_branches(spark):
    papers = spark.createDataFrame([
        ("b", 1, "missing_abstract", None), ("b", 2, "screening_failed", None), ("b", 3, "screened", "Include"), ("b", 4, "screened", "Include"),
        ("b", 5, "screened", "Include"), ("b", 6, "screened", "Maybe"), ("b", 7, "screened", "Include"), ("b", 8, "screened", "Exclude")],
        "batch_id string, row long, screening_status string, decision string")
    review = "struct<decision:string>"
    reviews = spark.createDataFrame([
        ("b", 4, (None,), None), ("b", 5, ("Include",), None), ("b", 6, ("Include",), None), ("b", 7, ("Exclude",), (None,)),
        ("b", 8, ("Include",), ("Include",))], f"batch_id string, row long, second_reviewer {review}, judge {review}")
    got = {x.row: (x.consensus_status, x.consensus_decision) for x in p.resolve_reviews(papers, reviews).collect()}
    assert got == {1: ("manual_full_text_required", None), 2: ("first_failed", None), 3: ("awaiting_second_reviewer", None),
                   4: ("second_reviewer_failed", None), 5: ("agreed", "Include"), 6: ("awaiting_judge", None), 7: ("judge_failed", None),
                   8: ("adjudicated", "Include")}


def test_review_log_equals_sequential_replay(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events, first = [], {1: "Include", 2: "Exclude", 3: "Maybe"}
    for i in range(120):
        role = rng.choice(["second_reviewer", "judge", "judge"])
        events.append(("b", rng.choice([1, 1, 1, 2, 3, 9]), i, start + timedelta(minutes=17 * i), role, rng.choice(["Include", "Exclude"]),
                       rng.choice(["why", " "]), rng.choice(["now", "now", "now", "old"]), "human"))
    expected, state = {}, {}
    for _, row, i, _, role, decision, reason, fingerprint, _ in events:
        second, judge = state.get(row, (None, None))
        if fingerprint != "now":
            expected[i] = "wrong_fingerprint"
        elif role == "judge" and not reason.strip():
            expected[i] = "judge_needs_reason"
        elif row not in first:
            expected[i] = "paper_not_found"
        elif role == "judge" and judge is None and (second is None or second == first[row]):
            expected[i] = "not_ready"
        else:
            expected[i] = None
            state[row] = (decision, None) if role == "second_reviewer" else (second, decision)
    papers = spark.createDataFrame([("b", r, "screened", d) for r, d in first.items()], "batch_id string, row long, screening_status string, decision string")
    checked = p.check_review_events(spark.createDataFrame(events, EVENT), papers, "now")
    assert {x.event_id: x.reject_reason for x in checked.collect()} == expected
    folded = p.fold_review_events(checked.filter("reject_reason IS NULL").drop("reject_reason"))
    got = {x.row: (x.second_reviewer and x.second_reviewer.decision, x.judge and x.judge.decision) for x in folded.collect()}
    assert got == state


def test_judge_payload(spark):
    papers = spark.createDataFrame([("b", 1, "T\"x", "A", "screened", "Include", "all_criteria_passed")],
                                   "batch_id string, row long, title string, abstract string, screening_status string, decision string, reason string")
    events = spark.createDataFrame([("b", 1, 1, datetime(2024, 1, 1), "second_reviewer", "Exclude", "no", "f", "human")], EVENT)
    import json

    body = json.loads(p.judge_payload(papers, p.fold_review_events(events)).first().payload)
    assert body["title"] == 'T"x' and [a["role"] for a in body["reviewer_assessments"]] == ["primary", "second_reviewer"]
    assert "reason" not in body["reviewer_assessments"][0]


def test_match_branches(spark):
    papers = spark.createDataFrame([(1, "Alpha study", "10.1/a"), (2, "Beta", "10.1/b"), (3, "Beta!", ""), (4, "Straße", ""), (5, "Gamma", "10.1/g"),
                                    (6, "ﬁne", "10.1/f")], "row long, title string, doi string")
    library = spark.createDataFrame([
        (1, "Alpha  Study", "https://doi.org/10.1/A"), (2, "BETA", ""), (3, "Other", "10.1/b"), (4, "STRASSE", ""), (5, "gamma", "10.9/z"),
        (6, "nothing", ""), (7, "", ""), (8, "Fine", "10.1/f"), (9, "", "10.1/a")], "library_row long, title string, doi string")
    got = {x.library_row: (x.match_status, x.match_method, x.n_candidates) for x in k.match_library(library, papers).collect()}
    assert got == {1: ("proposed", "doi", 1), 2: ("ambiguous", "title", 2), 3: ("metadata_conflict", "doi", 1), 4: ("proposed", "title", 1),
                   5: ("metadata_conflict", "title", 1), 6: ("unmatched", None, 0), 7: ("unmatched", None, 0), 8: ("proposed", "doi", 1),
                   9: ("proposed", "doi", 1)}
    listed = k.match_candidates(k.match_library(library, papers), papers)
    assert sorted((x.match_key, x.row) for x in listed.collect()) == [("beta", 2), ("beta", 3)]


def test_hot_title_does_not_multiply_rows(spark):
    papers = spark.range(1, 2001).select(F.col("id").alias("row"), F.lit("Same title").alias("title"), F.lit("").alias("doi"))
    library = spark.range(1, 3001).select(F.col("id").alias("library_row"), F.lit("same TITLE").alias("title"), F.lit("").alias("doi"))
    out = k.match_library(library, papers)
    assert out.count() == 3000 and out.filter("n_candidates = 2000 AND match_status = 'ambiguous'").count() == 3000
    assert k.match_candidates(out, papers).count() == 2000


def test_recovery_rules(spark):
    schema = ("batch_id string, row long, title string, doi string, screening_status string, decision string, human_decision string, "
              "consensus_status string, consensus_decision string, extra map<string,string>")
    rows = [("b", 1, "", "", "screened", "Include", None, None, None, {"TITLE": " From extra ", "Doi": "doi:10.1/q"}),
            ("b", 2, "t", "", "screened", "Include", "Exclude", None, None, {}), ("b", 3, "t", "", "screened", "Exclude", "Maybe", None, None, {}),
            ("b", 4, "t", "", "screened", "Include", "Include", "awaiting_judge", None, {}), ("b", 5, "t", "", "missing_abstract", None, None, "manual_full_text_required", None, {}),
            ("b", 6, "t", "", "screening_failed", None, None, None, None, {}), ("b", 7, "t", "", "screened", "Likely include", None, None, None, {}),
            ("b", 8, "t", "", "screened", "Exclude", None, "adjudicated", "Include", {})]
    got = {x.row: x for x in k.recovery_list(spark.createDataFrame(rows, schema)).collect()}
    assert {r: (x.decision_source, x.recovery_reason) for r, x in got.items()} == {
        1: ("screening", "advance_to_full_text"), 3: ("human", "resolve_uncertainty"), 5: ("panel", "resolve_missing_abstract"),
        7: ("screening", "confirm_inclusion_gaps"), 8: ("panel", "advance_to_full_text")}
    assert got[1].title == "From extra" and got[1].doi == "10.1/q" and got[1].pdf_filename == "sr-b-r1.pdf"
