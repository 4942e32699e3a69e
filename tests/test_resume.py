"""Call log, stage store, stored runs, and the in-task searches they read from."""

import json
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citesieve.functions.models import Completer, Encoder
from citesieve.operators import completion as c
from citesieve.operators import dense as d
from citesieve.operators import keyword as kw
from citesieve.operators import selection as sel
from citesieve.operators.calls import CallLog, answered
from citesieve.operators.extraction import ExtractionConfig
from citesieve.operators.manifest import StageStore, with_fingerprint
from citesieve.operators.run import INDEX, StoredRun, run_all

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CRITERIA = [{"label": "A", "type": "include", "statement": "s0", "explicit_evidence_required": False, "confidence_threshold": 0.5, "ord": 0},
            {"label": "B", "type": "exclude", "statement": "s1", "explicit_evidence_required": False, "confidence_threshold": 0.5, "ord": 1}]


def screener():
    def complete(system, user, max_tokens):
        body = json.loads(user)
        if "limit" in body["abstract"] and max_tokens < 600:
            return {"text": "", "completion": "output_limit"}
        if "broken" in body["abstract"]:
            return "no json"
        if "down" in body["abstract"]:
            raise RuntimeError("connection refused")
        return json.dumps({"decision": "yes", "reason": "r"})

    return complete


def papers(spark, abstracts):
    return spark.createDataFrame([("b", i, "t", a) for i, a in enumerate(abstracts)], "batch_id string, row long, title string, abstract string")


def test_calls_stop_at_the_first_failure_and_are_used_again(spark, folder):
    cfg = c.CompletionConfig(context_tokens=100_000)
    log, model = CallLog(spark, f"{folder}/calls", slices=2), Completer(screener, "m1")
    some = papers(spark, ["fine", "fine", "limit", "broken", "down"])
    results, calls = c.screen_completer(some, CRITERIA, model, cfg, log)
    status = {r.row: r.screening_status for r in results.collect()}
    assert status == {0: "screened", 1: "screened", 2: "screened", 3: "screening_failed", 4: "screening_failed"}
    assert sorted((r.row, r.ord) for r in calls.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)]
    # equal requests are one call; a limit and a broken reply are two, an error is final
    assert log.rows().count() == 2 * 1 + 2 * 2 + 2 + 1
    _, again = c.screen_completer(some, CRITERIA, model, cfg, log)
    assert {(r.row, r.ord) for r in again.where("cache_hit").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)}
    assert log.rows().count() == 9 + 3  # only what failed was sent again
    c.screen_completer(some, CRITERIA, Completer(screener, "m2"), cfg, log)
    assert log.rows().count() == 12 + 9  # another model shares no replies
    assert log.made().agg(F.sum("calls")).first()[0] == 21
    with pytest.raises(ValueError):
        c.screen_completer(some, CRITERIA, Completer(screener), cfg, log)
    assert CallLog(spark, f"{folder}/calls").rows().count() == 21  # opening keeps what is there


def shuffled_bytes(spark):
    java = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_logged_requests_are_dealt_once(spark, folder):
    """Four papers of 300,000 random letters: a pass deals a text once, when its request is sent, and not when the log answers."""
    letters = random.Random(1)
    some = papers(spark, ["".join(letters.choices("abcdefghijkmnopqrstuvxyz", k=300_000)) for _ in range(4)] + ["fine", "fine"])
    some = some.union(spark.createDataFrame([(None, 9, "t", "no batch")], some.schema))
    cfg, log, model = c.CompletionConfig(context_tokens=10_000_000), CallLog(spark, f"{folder}/calls"), Completer(screener, "m1")
    table = f"{folder}/papers"
    some.write.parquet(table)
    start = shuffled_bytes(spark)
    _, calls = c.screen_completer(spark.read.parquet(table), CRITERIA, model, cfg, log)
    first = shuffled_bytes(spark)
    assert calls.count() == 6 * 2 + 1 and log.rows().count() == 5 * 2 + 1  # without a batch a paper has no second pass
    _, again = c.screen_completer(spark.read.parquet(table), CRITERIA, model, cfg, log)
    assert again.where("cache_hit").count() == 6 * 2 + 1
    assert first - start < 3 * 4 * 300_000 and shuffled_bytes(spark) - first < 300_000


def test_requests_reach_workers_in_small_batches(spark):
    def sizes():
        seen = []

        def complete(system, user, max_tokens):
            seen.append(user)
            return str(len(seen))

        return complete

    kinds = []

    class Watched(Completer):
        def complete(self, system, user, max_tokens):
            kinds.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
            return super().complete(system, user, max_tokens)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = answered(spark.range(3).select("id", F.col("id").cast("string").alias("u")), Watched(sizes), "", "u", 5, None, "p", None)
    assert out.count() == 3 and int(kinds[0]) <= 200 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_store_makes_what_is_stale_only(spark, folder):
    store = StageStore(spark, f"{folder}/store", 4)
    made = []

    def build(todo):
        made.append(sorted(r.doc_id for r in todo.collect()))
        rows = todo.where("doc_id <> 3").select("doc_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("v"))
        return {"t": rows, "errors": todo.where("doc_id = 3").select("doc_id", F.lit("nothing there").alias("error"))}

    def wanted(version, n=4):
        docs = spark.range(n).select(F.col("id").alias("doc_id"))
        return with_fingerprint(docs, "s", {"v": version}, id=F.col("doc_id").cast("string"))

    schema = "doc_id bigint, v string"
    assert store.advance("s", wanted(1), build, "t") and not store.advance("s", wanted(1), build, "t")
    assert store.current("s", "t", schema).count() == 6
    assert store.advance("s", wanted(1, 5), build, "t") and store.advance("s", wanted(2, 2), build, "t")
    assert made == [[0, 1, 2, 3], [4], [0, 1]]
    assert store.current("s", "t", schema).count() == 8 and store.table("t", schema).count() == 12
    docs = spark.range(9).select(F.col("id").alias("doc_id"))
    assert sorted(r.doc_id for r in store.inputs("s", docs).collect()) == [0, 1, 2, 4]
    one, two = (r.output_hash for r in store.manifest("s").where("doc_id IN (0, 2)").collect())
    assert one == two  # other settings, equal output: later stages have the same input
    # rows of a run that died before its manifest do not count, and reopening finds the rest
    store._append("t", docs.select("doc_id", F.lit("lost").alias("v"), F.lit("run-that-died").alias("run")), f"{schema}, run string")
    again = StageStore(spark, f"{folder}/store", 4)
    assert again.current("s", "t", schema).where("v = 'lost'").count() == 0 and again.current("s", "t", schema).count() == 8
    before = {tuple(r) for r in again.current("s", "t", schema).collect()}
    again.compact("s", {"t": schema})
    assert {tuple(r) for r in again.current("s", "t", schema).collect()} == before and not again.advance("s", wanted(1, 5).where("doc_id > 1"), build, "t")
    plan = again.current("s", "t", schema).groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # the bucketed tables need no shuffle inside documents


def letters():
    return lambda texts: np.array([[t.count(x) for x in "aeioustr"] for t in texts], dtype=np.float32).reshape(len(texts), 8)


def quoting():
    import re

    def complete(system, user, max_tokens):
        source, line = re.search(r"\[(chunk_\d+)\] Section: [^\n]*\n([^\n]*)", user).groups()
        ids = re.findall(r"Field ID: (\S+)", user)
        found = {"value": "x", "status": "extracted", "confidence": "high", "notes": None, "evidence": [{"source_id": source, "quote": line[:15].strip()}]}
        return json.dumps({i: found for i in ids} if ids else found)

    return complete


def test_stored_run_equals_a_plain_one(spark, folder):
    rng = random.Random(4)
    words = "alpha beta gamma delta outcome trial patients dose effect sample review method result table".split()
    texts = ["\n\n".join(["# Part one"] + [" ".join(rng.choices(words, k=30)) + "." for _ in range(6)]) for _ in range(6)] + ["", texts_of_none()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = spark.createDataFrame([("f0", 0, "trial dose", ["dose effect", "trial"]), ("f0", 1, "method", ["method result"]), ("f1", 2, "patients", ["patients"])],
                                 "field string, query_ix long, query string, keywords array<string>")
    fields = [{"id": f, "label": f, "group": "A", "value_type": "string", "description": "d"} for f in ("f0", "f1")]
    score = lambda: ((F.col("query_ix") * 31 + F.col("doc_id") * 17 + F.col("chunk_ix") * 7) % 101).cast("double")
    models = {"encoder": "e", "scorer": "s", "completer": "c"}
    args = (plan, fields, Encoder(letters), score, Completer(quoting, "c"))
    want, errors = run_all(docs, *args, per_query=4, max_fused=8)
    store, log = StageStore(spark, f"{folder}/run", 4), CallLog(spark, f"{folder}/calls")
    run = StoredRun(store, *args, models, log=log, per_query=4, max_fused=8)
    assert run.run(docs) == ["parsed", "index", "evidence", "extraction"]

    def shown(results):
        return sorted((r.doc_id, r.field, r.status, str(r.evidence), str(r.validation_errors)) for r in results.collect())

    assert shown(run.results()) == shown(want) and len(shown(want)) >= 12
    assert {r.doc_id for r in run.errors().collect()} == {r.doc_id for r in errors.collect()}
    sent = log.rows().count()
    assert run.run(docs) == [] and log.rows().count() == sent
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit("\n\nOne more trial of patients was made here."))).otherwise(F.col("text")))
    assert run.run(changed) == ["parsed", "index", "evidence", "extraction"]
    again = {r.doc_id for r in store.history().groupBy("doc_id", "stage").count().where("count > 1").collect()}
    assert again == {1} and log.rows().count() > sent
    later = StoredRun(store, *args, models, extraction=ExtractionConfig(max_tokens=99), log=log, per_query=4, max_fused=8)
    assert later.run(changed) == ["extraction"]
    assert store.status(docs.select("doc_id", F.lit(True).alias("has_pdf")), {"parsed": store.manifest("parsed").select("doc_id", "fingerprint")},
                        {"parsed": run.chunks()}).where("has_parsed").count() >= 6
    index = store.current("index", "index", INDEX)
    stored = sel.retrieve(run.chunks(), plan, Encoder(letters), score, index=index, per_query=4, max_fused=8)
    fresh = sel.retrieve(d.embed_chunks(run.chunks(), Encoder(letters)), plan, Encoder(letters), score, per_query=4, max_fused=8)
    key = ["doc_id", "field", "evidence_ix", "chunk_ix", "tier", "fusion_score"]
    assert sorted(map(tuple, stored.select(*key).collect())) == sorted(map(tuple, fresh.select(*key).collect()))
    assert {"matched_by", "selected_for_queries"} <= set(stored.columns)


def texts_of_none():
    return "   "


def test_leaders_over_many_blocks(spark):
    """More queries than a block holds, ties, and chunks in several batches: equal to a plain search."""
    rng = np.random.default_rng(3)
    x, q = rng.integers(-3, 4, (90, 4)).astype(float), rng.integers(-3, 4, (1200, 4)).astype(float)
    chunks = spark.createDataFrame([(int(i % 3), int(i), x[i].tolist()) for i in range(90)], "doc_id long, chunk_ix long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(int(i), q[i].tolist()) for i in range(1200)], "query_ix long, embedding array<double>")
    got = {(r.query_ix, r.doc_id, r["rank"]): (r.chunk_ix, r.score) for r in d.dense_search(chunks, queries, 4).collect()}
    scores = q @ x.T
    want = {}
    for a in range(1200):
        for doc in range(3):
            for rank, i in enumerate(sorted(range(doc, 90, 3), key=lambda i: (-scores[a, i], i))[:4], 1):
                want[a, doc, rank] = (i, scores[a, i])
    assert got == want
    assert d.dense_search(chunks, queries.limit(0), 4).count() == 0 and d.dense_search(chunks.limit(0), queries, 4).count() == 0


def test_bm25_equals_plain_sums(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 4, i, "s", " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_ix long, section string, text string").repartition(4)
    asked = [(i, " ".join(rng.choices(words, k=3))) for i in range(600)]
    queries = spark.createDataFrame(asked, "query_ix long, query string")
    found = kw.bm25_search(kw.build_postings(chunks, kw.WORD_PATTERN), kw.document_stats(chunks), queries, 3)
    got = {(r.query_ix, r.doc_id, r["rank"]): (r.chunk_ix, round(r.score, 6)) for r in found.collect()}
    want = {}
    for doc in range(4):
        own = {i: t.split() for k, i, _, t in rows if k == doc}
        mean = sum(map(len, own.values())) / len(own)
        idf = {w: np.log(1 + (len(own) - n + 0.5) / (n + 0.5)) for w in words for n in (sum(w in t for t in own.values()),)}
        for a, text in asked:
            score = {i: sum(idf[w] * t.count(w) / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split()) for i, t in own.items()}
            best = sorted((i for i in own if round(score[i], 9) > 0), key=lambda i: (-round(score[i], 9), i))[:3]
            want |= {(a, doc, r): (i, round(score[i], 6)) for r, i in enumerate(best, 1)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_fields_beyond_the_bound_are_named(spark):
    queries = spark.createDataFrame([("a", i, "q") for i in range(5)] + [("b", 9, "q")], "field string, query_ix long, query string")
    assert [tuple(r) for r in sel.uncovered_fields(queries, 4).collect()] == [("a", 5, 4)]


def test_streams_read_a_table_of_one_file_and_of_many(spark, folder):
    from citesieve.plans import streams

    rows = spark.range(30).select((F.col("id")).alias("doc_id"), F.concat(F.lit("title "), "id", F.lit("\nbody")).alias("text"),
                                  F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(10).cast("bigint").alias("n_chars"))
    rows.toPandas().to_parquet(f"{folder}/documents.parquet")
    rows.repartition(3).write.parquet(f"{folder}/many/documents.parquet")
    for sf in (folder, f"{folder}/many"):
        assert streams.screen(spark, sf).select("row").distinct().count() == 30
        assert sum(x.n for x in streams.resume(spark, sf).collect()) == 30
