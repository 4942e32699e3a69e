"""What goes to disk: appends to stage tables, and results of model calls."""

import json
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from citesieve.functions.models import Completer
from citesieve.operators import calls
from citesieve.operators import extraction as e
from citesieve.operators.manifest import StageStore
from citesieve.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def last_plan(spark):
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    return done.apply(done.size() - 1).physicalPlanDescription()


def test_stored_rows_are_not_sorted_by_bucket(spark, folder):
    store, schema = StageStore(spark, f"{folder}/store", 4), "doc_id bigint, v string, run string"
    rows = spark.range(40).select(F.col("id").alias("doc_id"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store._append("t", rows, schema, lambda dealt: dealt.withColumns({"v": F.repeat(F.lit("long text "), 20), "run": F.lit("r")}))
    plan = last_plan(spark)
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    stored = store.table("t", schema.removesuffix(", run string"))
    assert stored.count() == 40 and len(stored.inputFiles()) == 4
    assert "Exchange hashpartitioning" not in stored.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()


def test_errors_are_found_in_what_was_stored(spark, folder):
    store = StageStore(spark, f"{folder}/store", 4)
    todo = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("f").alias("fingerprint"))

    def build(todo):
        rows = todo.select("doc_id")
        return {"t": (rows, lambda dealt: dealt.withColumn("v", F.col("doc_id") * 10)),
                "errors": lambda stored: stored.where("v = 20").select("doc_id", F.lit("twenty").alias("error"))}

    assert store.advance("s", todo, build, "t")
    assert {(r.doc_id, r.error) for r in store.manifest("s").collect()} == {(0, None), (1, None), (2, "twenty")}
    assert sorted(r.v for r in store.current("s", "t", "doc_id bigint, v bigint").collect()) == [0, 10, 20]


def replying():
    """Sound for document 0, no JSON for document 1, a false quote for document 2 until its field is asked alone, down for document 3."""
    def complete(system, user, max_tokens):
        text = re.search(r"\] Section: [^\n]*\n([^\n]*)", user).group(1)
        ids = re.findall(r"Field ID: (\S+)", user)
        if "one" in text:
            return "no json"
        if "three" in text:
            raise RuntimeError("down")
        quote = "never said" if "two" in text and ids else text
        found = {"value": "x", "status": "extracted", "confidence": "high", "notes": None, "evidence": [{"source_id": "chunk_0", "quote": quote}]}
        return json.dumps({i: found for i in ids} if ids else found)

    return complete


def test_results_are_written_without_the_texts_they_were_found_in(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(calls, "cut_lineage", lambda df: seen.append(df.columns) or cut_lineage(df))
    chunks = spark.createDataFrame([(i, 0, "s", f"text {n}") for i, n in enumerate(["zero", "one", "two", "three"])], "doc_id long, chunk_ix int, section string, text string")
    docs = spark.range(5).select(F.col("id").alias("doc_id"))
    fields = [{"id": "f", "label": "f", "group": "A", "value_type": "string", "description": "d"}]
    evidence = chunks.select("doc_id", F.lit("f").alias("field"), F.lit(0).alias("evidence_ix"), "chunk_ix")
    for log in (None, calls.CallLog(spark, f"{folder}/calls")):
        seen.clear()
        out = {r.doc_id: (r.status, r.error, len(r.evidence)) for r in e.extract_groups(evidence, chunks, docs, fields, Completer(replying, "m"), log=log).collect()}
        assert out == {0: ("extracted", None, 1), 1: ("llm_failed", "reply holds no JSON object", 0), 2: ("extracted", None, 1), 3: ("llm_failed", "down", 0), 4: ("no_evidence", None, 0)}
        assert len(seen) == 2 and not any({"passages", "sources", "_prompt", "plain_sources"} & set(columns) for columns in seen)
