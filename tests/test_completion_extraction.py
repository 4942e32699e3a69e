import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citesieve.functions.json_values import salvage_json, stringify_value, valid_value
from citesieve.functions.models import Completer
from citesieve.functions.text import plain_layout
from citesieve.operators import completion as c
from citesieve.operators import extraction as e
from citesieve.operators import provenance as pv
from citesieve.session import config_rows, cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CRITERIA = [{"label": "A", "statement": "first", "type": "include"}, {"label": "B", "statement": "second", "type": "exclude"}]


def papers(spark, *titles):
    return spark.createDataFrame([("b", i + 1, t, "abstract text" if t else "") for i, t in enumerate(titles)],
                                 "batch_id string, row long, title string, abstract string")


def scripted():
    def complete(system, user, max_tokens):
        body = json.loads(user)
        title, statement = body["title"], body["criteria"][0]["statement"]
        if title == "down" and statement == "second":
            raise RuntimeError("Context length exceeded")
        if title == "long":
            return {"text": "", "completion": "output_limit"} if max_tokens < 150 else {"text": '{"decision":"yes","reason":"ok"}'}
        if title == "endless":
            return {"text": "", "completion": "output_limit"}
        if title == "broken":
            return "{"
        return json.dumps({"decision": "yes" if statement == "first" else "no", "reason": "r"})

    return complete


def test_screening_with_a_model(spark):
    cfg = c.CompletionConfig(max_output_tokens=100, context_tokens=700, template_token_reserve=50, response_retries=1)
    results, calls = c.screen_completer(papers(spark, "fine", "down", "long", "endless", "broken", "", "x" * 900), CRITERIA, Completer(scripted), cfg)
    got = {x.row: (x.screening_status, x.decision) for x in results.collect()}
    assert got == {1: ("screened", "Include"), 2: ("input_too_long", None), 3: ("screened", "Exclude"), 4: ("output_too_long", None),
                   5: ("screening_failed", None), 6: ("missing_abstract", None), 7: ("input_too_long", None)}
    attempts = {(x.row, x.ord): [a.output_token_budget for a in x.attempts] for x in calls.filter("attempts IS NOT NULL").collect()}
    assert attempts[3, 0] == [100, 200] and attempts[5, 0] == [100, 100] and attempts[1, 0] == [100]
    audit = {x.row: x.calls for x in c.call_audit(calls).collect()}
    assert audit[1] == 2


@pytest.mark.parametrize("reply, error", [
    ('{"decision":"yes","reason":"r","quote":null,"confidence":1}', None),
    ('{"decision":"yes","reason":"r","quote":"abstract","confidence":7}', None),
    ('{"decision":"yes","reason":"r","quote":"Abstract","confidence":0.1}', "quote_not_verbatim"),
    ('{"decision":"yes","reason":"r","quote":" ","confidence":0.1}', "quote_not_verbatim"),
    ('{"decision":"yes","reason":"r","quote":3,"confidence":0.1}', "quote_not_text"),
    ('{"decision":"uncertain","reason":"r","quote":null,"confidence":0.1}', "invalid_decision"),
    ('{"decision":"yes","reason":"r","quote":null,"confidence":true}', "confidence_not_a_number"),
    ('{"decision":"yes","reason":"r","quote":null,"confidence":NaN}', "not_strict_json"),
    ('{"decision":"yes","decision":"yes","reason":"r","quote":null,"confidence":1}', "not_strict_json"),
    ('{"decision":"yes","reason":"","quote":null,"confidence":1}', "blank_reason"),
    ('{"decision":"yes","quote":null,"confidence":1}', "unexpected_or_missing_keys"),
    ('[1]', "not_an_object"),
])
def test_reply_contract(spark, reply, error):
    cfg = c.CompletionConfig(extract_evidence=True, include_confidence_score=True)
    row = c.check_contract(papers(spark, "t").withColumn("text", F.lit(reply)), cfg).first()
    assert row.reply_error == error
    if error is None:
        assert row.reply_confidence == (None if "7" in reply else 1.0)


def test_value_types(spark):
    cases = [("7", "integer", True), ("7.0", "integer", False), ("7.5", "number", True), ("true", "number", False), ("true", "boolean", True),
             ('"a"', "string", True), ('["a"]', "array", True), ("[]", "array", True), ('["a",1]', "array", False), ('["a",null]', "array", False),
             ("[null]", "array", False), ("7", "string", False)]
    df = spark.createDataFrame(cases, "j string, t string, ok boolean").withColumn("v", F.parse_json("j"))
    assert df.filter(~F.coalesce(valid_value(F.col("v"), F.col("t")), F.lit(False)).eqNullSafe(F.col("ok"))).collect() == []
    texts = [x[0] for x in df.select(stringify_value("v")).collect()]
    assert texts[0] == "7" and texts[5] == "a" and texts[6] == '["a"]' and texts[4] == "true"


def test_salvage(spark):
    replies = ['{"a":1}', 'Sure: {"a":2} done {"b":3}', "{bad {\"a\":4}", "none", None, "[1]"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [x[0] for x in df.select(F.to_json(salvage_json("r"))).collect()]
    assert got == ['{"a":1}', '{"a":2}', '{"a":4}', None, None, None]


FIELDS = [{"id": "n", "label": "Count", "group": "G", "value_type": "integer", "description": "how many"},
          {"id": "k", "label": "Kind", "group": "G", "value_type": "string", "description": "which", "allowed_values": ["x"]}]


def extractor():
    def complete(system, user, max_tokens):
        found = re.search(r"\[(chunk_\d+)\]", user).group(1)
        if "doc three" in user:
            raise RuntimeError("down")

        def field(value, quote="the quote"):
            return {"value": value, "status": "extracted", "confidence": "high", "notes": None, "evidence": [{"source_id": found, "quote": quote}]}

        if "Field ID" in user:
            return "Reply " + json.dumps({"n": field(3), "k": field("y")})
        return json.dumps(field("x" if "Kind" in user else 3))

    return complete


def test_extract_groups(spark):
    chunks = spark.createDataFrame([(1, 0, "s", "has THE  quote", "paragraph"), (2, 0, "s", "nothing here", "paragraph"), (3, 0, "s", "doc three", "paragraph")],
                                   "doc_id long, chunk_ix int, section string, text string, kind string")
    evidence = spark.createDataFrame([(d, f, 0, 0) for d in (1, 2, 3) for f in ("Count", "Kind")], "doc_id long, field string, evidence_ix int, chunk_ix int")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    out = e.extract_groups(evidence, chunks, docs, FIELDS, Completer(extractor))
    got = {(x.doc_id, x.field): (x.status, x.v) for x in out.withColumn("v", stringify_value("value")).collect()}
    assert got == {(1, "Count"): ("extracted", "3"), (1, "Kind"): ("extracted", "x"), (2, "Count"): ("invalid_output", None),
                   (2, "Kind"): ("invalid_output", None), (3, "Count"): ("llm_failed", None), (3, "Kind"): ("llm_failed", None),
                   (4, "Count"): ("no_evidence", None), (4, "Kind"): ("no_evidence", None)}
    assert {x.doc_id: x.complete for x in e.extraction_complete(out, FIELDS).collect()} == {1: True, 2: False, 3: False, 4: False}
    long = e.extraction_long(docs, out, FIELDS).collect()
    assert len(long) == 8 and {x.doc_id for x in long if x.value} == {1}


def planner():
    state = {"calls": 0}

    def complete(system, user, max_tokens):
        state["calls"] += 1
        labels = re.findall(r"Field: (.*)", user)
        if "Kind" in user:
            return json.dumps({x: {"queries": ["q"], "keywords": ["one"]} for x in labels})
        return "Plan: " + json.dumps({x: {"queries": ["q", 5, " "], "keywords": ["a", "b"]} for x in labels})

    return complete


def test_plan_queries(spark):
    fields = spark.createDataFrame([(0, 0, "Count", "how many"), (0, 1, "Kind", "which")], "group_ord int, field_ord int, label string, description string")
    plan, failed = e.plan_queries(fields, Completer(planner), e.ExtractionConfig(), batch=1, retries=1)
    assert [(x.label, x.queries, x.keywords) for x in plan.collect()] == [("Count", ["q"], ["a", "b"])]
    assert [x.batch for x in failed.collect()] == [1]


def test_full_text_budget(spark):
    docs = spark.createDataFrame([(1, "short text\n# References\nx"), (2, "word " * 500)], "doc_id long, text string")
    reply = lambda: lambda s, u, m: json.dumps({f["label"]: {"value": None, "status": "unclear", "confidence": "low", "source_quote": None} for f in FIELDS})
    out = e.extract_full(docs, FIELDS, Completer(reply), e.ExtractionConfig(max_context_tokens=300, full_max_tokens=50))
    assert {(x.doc_id, x.status) for x in out.collect()} == {(1, "unclear"), (2, "context_too_large")}


def test_prompts(spark):
    spec = e.field_specification(FIELDS[1])
    assert spec.endswith("Required value type: string\nAllowed values: ['x']")
    text = spark.range(1).select(e.render_prompt("passage", id=F.lit("chunk_1"), section=F.lit("S"), text=F.lit("body"))).first()[0]
    assert text == "[chunk_1] Section: S\nbody"


def test_session_helpers(spark):
    with pytest.raises(ValueError):
        config_rows(spark.range(10), 5)
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3 and spark.sparkContext.getCheckpointDir()


def test_provenance(spark):
    assert pv.settings_hash({"b": 1, "a": [1]}) == pv.settings_hash({"a": [1], "b": 1})
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, t string")
    one = {x.doc_id: x.output_hash for x in pv.output_hash(df).collect()}
    two = {x.doc_id: x.output_hash for x in pv.output_hash(df.orderBy(F.desc("t")).repartition(3)).collect()}
    assert one == two and one[1] != one[2]
    plan = [{"label": "a", "queries": ["q"]}]
    saved = pv.plan_identity(plan, FIELDS)
    assert pv.plan_is_current(plan, FIELDS, saved) and not pv.plan_is_current(plan, FIELDS[:1], saved)


def test_quotes_are_found_in_plain_layout(spark):
    """The one-pass form equals the plain rules for every kind of whitespace and for letters whose folding is longer."""
    spaces = ["\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "  ", " \n ", "\n\n"]
    texts = [f"{s}Stra\u00dfe{s}A B{s}c\ufb01{s}" for s in spaces] + ["", "one two", "  lead", "tail  ", "\u180e x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r.i: (r.plain, r.found) for r in df.select("i", plain_layout("t").alias("plain"), e.plain_sources(F.create_map(F.lit("k"), F.col("t")))["k"].alias("found")).collect()}
    for i, t in enumerate(texts):
        want = re.sub(r"[\s\x1c-\x1f]+", " ", t or "").strip(" ").casefold()
        assert out[i] == (want, None if t is None else want)
    held = df.select(e.check_evidence(F.array(F.struct(F.lit("k").alias("source_id"), F.lit("STRASSE a").alias("quote"))),
                                      e.plain_sources(F.create_map(F.lit("k"), F.col("t"))), True)[0]["fault"].alias("fault"))
    assert [r.fault for r in held.collect()] == [None] * len(spaces) + ["quote_not_in_source"] * 5 + ["unknown_source"]


def test_long_results_are_read_once_and_repeats_stay(spark):
    fields = [{"label": "f0"}, {"label": "f1"}]
    rows = spark.range(0, 7).select(F.floor(F.col("id") / 2).alias("doc_id"), F.when(F.col("id") % 2 == 0, "f0").otherwise("f1").alias("field"), F.parse_json(
        F.lit('"x"')).alias("value"), F.when(F.col("id") == 5, "invalid_output").otherwise("extracted").alias("status"), F.lit("high").alias("confidence"), F.array(
        F.struct(F.lit("k").alias("source_id"), F.lit("q").alias("quote"))).alias("evidence"), F.array().cast("array<string>").alias("validation_errors"), F.lit(None).cast("string").alias("error"))
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    long = e.extraction_long(docs, rows, fields)
    assert long._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 7") == 1
    assert sorted((r.doc_id, r.label, r.value, tuple(r.quotes)) for r in long.collect()) == [
        (d, f, *(("x", ("q",)) if d < 2 else (None, ()))) for d in range(5) for f in ("f0", "f1")]
    every = e.extraction_long(docs, rows.unionByName(rows.where("doc_id = 0 AND field = 'f0'")), fields, only_complete=False)
    assert sorted((r.doc_id, r.label, r.value) for r in every.collect() if r.doc_id in (0, 3)) == [
        (0, "f0", "x"), (0, "f0", "x"), (0, "f1", "x"), (3, "f0", "x"), (3, "f1", None)]
