"""Queries of planning, field extraction, exports and provenance."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from citesieve.functions.models import Completer, Encoder
from citesieve.operators import extraction as e
from citesieve.operators import provenance as pv
from citesieve.operators.calls import CallLog
from citesieve.operators.manifest import StageStore
from citesieve.operators.run import StoredRun, run_all
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry
from citesieve.plans.review import labelled
from citesieve.plans.search import SQL_LINES, arithmetic_score, hashed_encoder
from citesieve.session import compute_once, cut_lineage, new_folder
from citesieve.sources import sinks

QUERIES, ORACLES, register = registry()

FIELDS = [
    {"id": "f0", "label": "f0", "group": "A", "value_type": "string", "description": "What is it?"},
    {"id": "f1", "label": "f1", "group": "A", "value_type": "string", "description": "Which one?", "allowed_values": ["x", "y"]},
    {"id": "f2", "label": "f2", "group": "A", "value_type": "integer", "description": "How many?"},
    {"id": "f3", "label": "f3", "group": "B", "value_type": "number", "description": "How much?"},
    {"id": "f4", "label": "f4", "group": "B", "value_type": "array", "description": "Which ones?"},
]


def evidence(spark, sf):
    """Every line is evidence of two fields, which take turns."""
    rows = fx.lines(spark, sf).select("doc_id", "chunk_ix", F.inline(F.array(
        F.struct((F.col("chunk_ix") % 5).alias("f"), (F.floor(F.col("chunk_ix") / 5) * 2).alias("evidence_ix")),
        F.struct(((F.col("chunk_ix") * 2 + 1) % 5).alias("f"), (F.floor(F.col("chunk_ix") / 5) * 2 + 1).alias("evidence_ix")))))
    return rows.select("doc_id", F.concat(F.lit("f"), "f").alias("field"), F.col("evidence_ix").cast("int").alias("evidence_ix"), "chunk_ix")


SQL_EVIDENCE = """evid AS (
  SELECT doc_id, chunk_ix, chunk_ix % 5 AS f, (chunk_ix // 5) * 2 AS evidence_ix FROM lined
  UNION ALL SELECT doc_id, chunk_ix, (chunk_ix * 2 + 1) % 5, (chunk_ix // 5) * 2 + 1 FROM lined)"""


@register("group_evidence", fx.sql(SQL_LINES, SQL_EVIDENCE, """turns AS (
  SELECT doc_id, CASE WHEN f < 3 THEN 0 ELSE 1 END AS unit, chunk_ix, min(evidence_ix * 10 + CASE WHEN f < 3 THEN f ELSE f - 3 END) AS turn FROM evid GROUP BY ALL)""", select="""
SELECT doc_id, unit, chunk_ix, (row_number() OVER (PARTITION BY doc_id, unit ORDER BY turn, chunk_ix))::INT AS place FROM turns QUALIFY place <= 6"""))
def grouped(spark, sf):
    return e.group_evidence(evidence(spark, sf), e.with_units(FIELDS, 24), 6)


@register("split_groups", """
SELECT n_nationkey, ((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 2)::INT AS unit FROM nation""")
def split(spark, sf):
    fields = fx.table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("group_ord"), F.col("n_nationkey").alias("field_ord"))
    return e.split_groups(fields, 2).select("n_nationkey", "unit")


@register("specification", """
SELECT n_nationkey, 'Field: ' || n_name || chr(10) || 'Description: in region ' || n_regionkey || chr(10) || 'Rules: ' || chr(10) || 'Required value type: string'
  || chr(10) || 'Allowed values: ' || CASE WHEN n_regionkey = 0 THEN 'None' ELSE '[''' || n_name || ''', ''other'']' END AS specification FROM nation""")
def specification(spark, sf):
    fields = fx.table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_name").alias("label"), F.concat(F.lit("in region "), "n_regionkey").alias("description"),
        F.lit(None).cast("string").alias("rules"), F.lit(None).cast("string").alias("value_type"),
        F.when(F.col("n_regionkey") != 0, F.array("n_name", F.lit("other"))).alias("allowed_values"))
    return e.specification_column(fields).select("n_nationkey", "specification")


def field_objects(spark, sf):
    """A field object per document and field: sound ones, and one of each fault."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("chunk_0"), F.col("text")).alias("sources"), F.right("text", F.lit(8)).alias("q"))
    docs = compute_once(docs, {"plain_sources": e.plain_sources("sources")}).drop("sources")
    rows = docs.select("*", F.inline(F.array(*[F.struct(
        F.lit(f["label"]).alias("field"), F.lit(i).alias("i"), F.lit(f["value_type"]).alias("value_type"),
        F.array(*[F.lit(a) for a in f.get("allowed_values", [])]).cast("array<string>").alias("allowed_values")) for i, f in enumerate(FIELDS)])))
    turn = F.when(F.col("doc_id") % 3 == 0, 0).otherwise((F.col("doc_id") + F.col("i")) % 8)
    good = F.element_at(F.create_map(*[F.lit(x) for x in ["string", '"x"', "integer", "12", "number", "1.5", "array", '["a"]']]), F.col("value_type"))
    wrong = F.element_at(F.create_map(*[F.lit(x) for x in ["string", "7", "integer", "7.0", "number", "true", "array", '"a"']]), F.col("value_type"))

    def item(source, quote):
        return F.concat(F.lit("["), F.to_json(F.struct(F.lit(source).alias("source_id"), quote.alias("quote"))), F.lit("]"))

    def body(value, status, items):
        return F.concat(F.lit('{"value":'), value, F.lit(f',"status":"{status}","confidence":"high","notes":null,"evidence":'), items, F.lit("}"))

    sound = item("chunk_0", F.lower("q"))
    text = (F.when(turn == 1, body(good, "extracted", item("chunk_999", F.col("q")))).when(turn == 2, body(good, "extracted", item("chunk_0", F.lit("zzqq zz"))))
            .when(turn == 3, body(wrong, "extracted", sound)).when(turn == 4, body(F.lit("null"), "not_reported", F.lit("[]")))
            .when(turn == 5, body(good, "extracted", F.lit("[]"))).when(turn == 6, body(good, "done", sound))
            .when((turn == 7) & (F.col("field") == "f1"), body(F.lit('"q"'), "extracted", sound)).otherwise(body(good, "extracted", sound)))
    return rows.withColumn("raw", F.parse_json(text))


SQL_OBJECTS = """objects AS (
  SELECT doc_id, 'f' || i AS field, i, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id + i) % 8 END AS turn FROM documents, range(0, 5) r(i)),
judged AS (
  SELECT *, CASE WHEN turn = 1 THEN 'unknown_source' WHEN turn = 2 THEN 'quote_not_in_source'
                 WHEN turn = 3 AND i = 1 THEN 'wrong_type,outside_allowed_values' WHEN turn = 3 THEN 'wrong_type' WHEN turn = 5 THEN 'evidence_required'
                 WHEN turn = 6 THEN 'invalid_status' WHEN turn = 7 AND i = 1 THEN 'outside_allowed_values' ELSE '' END AS errors FROM objects),
resulted AS (
  SELECT *, CASE WHEN errors <> '' THEN 'invalid_output' WHEN turn = 4 THEN 'not_reported' ELSE 'extracted' END AS status,
         CASE WHEN errors = '' AND turn <> 4 THEN CASE i WHEN 2 THEN '12' WHEN 3 THEN '1.5' WHEN 4 THEN '["a"]' ELSE 'x' END END AS value FROM judged)"""


def results(spark, sf):
    return e.validate_fields(field_objects(spark, sf))


@register("field_errors", fx.sql(SQL_OBJECTS, select="""
SELECT doc_id, field, CASE WHEN errors IN ('unknown_source', 'quote_not_in_source') THEN '' ELSE errors END AS errors FROM judged"""))
def errors(spark, sf):
    return field_objects(spark, sf).select("doc_id", "field", F.array_join(e.field_errors(
        F.col("raw"), F.col("value_type"), F.col("allowed_values")), ",").alias("errors"))


@register("check_evidence", fx.sql(SQL_OBJECTS, select="SELECT doc_id, field, status, errors, value FROM resulted"))
def validated(spark, sf):
    return results(spark, sf).select("doc_id", "field", "status", F.array_join("validation_errors", ",").alias("errors"), e.stringify_value("value").alias("value"))


@register("extraction_complete", fx.sql(SQL_OBJECTS, select="SELECT doc_id, bool_and(errors = '') AS complete FROM judged GROUP BY ALL"))
def complete(spark, sf):
    return e.extraction_complete(results(spark, sf), FIELDS)


SQL_LONG = """done AS (SELECT doc_id FROM judged GROUP BY ALL HAVING bool_and(errors = '')),
long AS (
  SELECT o.doc_id, o.field AS label, value, CASE WHEN d.doc_id IS NOT NULL THEN status END AS status, CASE WHEN d.doc_id IS NOT NULL THEN 'high' END AS confidence,
         CASE WHEN d.doc_id IS NOT NULL AND turn <> 4 THEN trim(lower(right(text, 8))) ELSE '' END AS quotes
  FROM (SELECT doc_id, field, turn, status, CASE WHEN doc_id IN (SELECT doc_id FROM done) THEN value END AS value FROM resulted) o
  JOIN documents USING (doc_id) LEFT JOIN done d ON o.doc_id = d.doc_id)"""


@register("extraction_long", fx.sql(SQL_OBJECTS, SQL_LONG, select="SELECT * FROM long"))
def long(spark, sf):
    out = e.extraction_long(fx.table(spark, sf, "documents").select("doc_id"), results(spark, sf), FIELDS)
    return out.select("doc_id", "label", "value", "status", "confidence", F.array_join("quotes", " | ").alias("quotes"))


@register("extraction_wide", fx.sql(SQL_OBJECTS, SQL_LONG, select="SELECT doc_id AS paper, " + ", ".join(
    f"max(coalesce({col}, '')) FILTER (label = '{f['label']}') AS \"{f['label']}{name}\"" for f in FIELDS
    for col, name in [("value", ""), ("status", " status"), ("confidence", " confidence"), ("quotes", " evidence")]) + " FROM long GROUP BY ALL"))
def wide(spark, sf):
    out = e.extraction_long(fx.table(spark, sf, "documents").select("doc_id"), results(spark, sf), FIELDS)
    return sinks.extraction_wide(out, [f["label"] for f in FIELDS])


@register("reuse_valid_fields", fx.sql(SQL_OBJECTS, select="""
SELECT doc_id, field, errors = '' AND doc_id % 2 = 0 AS reused FROM judged"""))
def reused(spark, sf):
    prior = results(spark, sf).select("doc_id", "field", "status", F.when(F.col("doc_id") % 2 == 0, "now").otherwise("old").alias("fingerprint"))
    prior = cut_lineage(prior)  # stored results of an earlier run, which both sides read
    todo, kept = e.reuse_valid_fields(prior.select("doc_id", "field"), prior, "now")
    return todo.withColumn("reused", F.lit(False)).unionByName(kept.select("doc_id", "field", F.lit(True).alias("reused")))


@register("stringify_value", fx.sql(SQL_OBJECTS, select="""
SELECT doc_id, field, CASE WHEN turn = 4 THEN NULL WHEN turn = 3 THEN CASE i WHEN 2 THEN '7' WHEN 3 THEN 'true' WHEN 4 THEN 'a' ELSE '7' END
   WHEN turn = 7 AND i = 1 THEN 'q' ELSE CASE i WHEN 2 THEN '12' WHEN 3 THEN '1.5' WHEN 4 THEN '["a"]' ELSE 'x' END END AS value FROM objects"""))
def stringified(spark, sf):
    return field_objects(spark, sf).select("doc_id", "field", F.regexp_replace(
        e.stringify_value(e.member(F.col("raw"), "value")), r"\.0$", "").alias("value"))


SQL_PLAN = """plan AS (
  SELECT 'q' || item_id AS label, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 1 END AS nq, least(CASE WHEN item_id % 7 = 3 THEN 1 ELSE 3 END,
         len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')))) AS nk FROM benchmark),
fields AS (SELECT 'q' || (doc_id * 2) AS label FROM documents)"""


@register("check_plan", fx.sql(SQL_PLAN, select="""
SELECT label, 'missing_field' AS reject_reason FROM fields WHERE label NOT IN (SELECT label FROM plan)
UNION ALL SELECT label, CASE WHEN nq < 1 THEN 'no_query' ELSE 'too_few_keywords' END FROM plan WHERE label IN (SELECT label FROM fields) AND (nq < 1 OR nk < 2)
UNION ALL SELECT label, 'unknown_field' FROM plan WHERE label NOT IN (SELECT label FROM fields)"""))
def plan_faults(spark, sf):
    return e.check_plan(plan_rows(spark, sf), fx.table(spark, sf, "documents").select(F.concat(F.lit("q"), F.col("doc_id") * 2).alias("label")), True)


def plan_rows(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return fx.table(spark, sf, "benchmark").select(
        F.concat(F.lit("q"), "item_id").alias("label"), F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("text")).alias("queries"),
        F.when(F.col("item_id") % 7 == 3, F.slice(words, 1, 1)).otherwise(words).alias("keywords"))


@register("parse_plan", r"""
SELECT item_id, 'q' || item_id AS label, CASE WHEN item_id % 3 = 2 THEN '' ELSE text END AS query, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS keywords
FROM benchmark""")
def plans(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    query = F.when(F.col("item_id") % 3 == 2, F.array(F.lit("  "))).otherwise(F.array("text"))
    body = F.to_json(F.create_map(F.concat(F.lit("q"), "item_id"), F.struct(query.alias("queries"), words.alias("keywords"))))
    reply = F.when(F.col("item_id") % 2 == 0, body).otherwise(F.concat(F.lit("Here is the plan:\n"), body, F.lit("\nDone.")))
    parsed = fx.table(spark, sf, "benchmark").select("item_id", F.inline(e.parse_plan(reply)))
    return parsed.select("item_id", "label", F.array_join("queries", "|").alias("query"), F.size("keywords").cast("bigint").alias("keywords"))


def copying_completer():
    """Stand-in for a model: quotes the first passage for every field it is asked for; every seventh request fails."""
    def complete(system, user, max_tokens):
        found = re.search(r"\[(chunk_\d+)\] Section: [^\n]*\n([^\n]*)", user)
        if len(user) % 7 == 0 and "Field ID:" in user:
            raise RuntimeError("service unavailable")
        quote = (found.group(2)[:20].strip() or "none") if found else "none"
        source = found.group(1) if found else "none"

        def field(kind):
            value = {"string": "x", "integer": 12, "number": 1.5, "array": ["a"], "boolean": True}[kind]
            return {"value": value, "status": "extracted", "confidence": "high", "evidence": [{"source_id": source, "quote": quote}], "notes": None}

        ids = re.findall(r"Field ID: (\S+)\n(?:.*\n){3}Required value type: (\S+)", user)
        if ids:
            return "Result: " + json.dumps({i: field(kind) for i, kind in ids})
        return json.dumps(field(re.search(r"Required value type: (\S+)", user).group(1)))

    return complete


@register("extract_groups")
def extracted(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    out = e.extract_groups(evidence(spark, sf), fx.lines(spark, sf), docs, FIELDS, Completer(copying_completer))
    return out.select("doc_id", "field", "status", "confidence", e.stringify_value("value").alias("value"), F.size("evidence").alias("n_evidence"))


def full_completer():
    """Stand-in for a model over a whole text: quotes its first words."""
    def complete(system, user, max_tokens):
        paper = user.split("--- BEGIN PAPER ---\n", 1)[1].rsplit("\n--- END PAPER ---", 1)[0]
        quote = " ".join(paper.split()[:4])
        return json.dumps({label: {"value": "x", "status": "extracted", "confidence": "low", "source_quote": quote, "source_section": None}
                           for label in re.findall(r"Field: (\S+)", user.split("--- BEGIN PAPER ---")[0])})

    return complete


@register("extract_full", fx.sql(r"""sized AS (
  SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n FROM documents)""", select="""
SELECT doc_id, field, CASE WHEN n > 1500 THEN 'context_too_large' WHEN field IN ('f0') THEN 'extracted' ELSE 'invalid_output' END AS status
FROM sized, (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f4')) f(field) WHERE field <> 'f1'
UNION ALL SELECT doc_id, 'f1', CASE WHEN n > 1500 THEN 'context_too_large' ELSE 'extracted' END FROM sized"""))
def full(spark, sf):
    text = "\n\n".join(e.field_specification(f) for f in FIELDS)
    fixed = len(re.findall(r"\w+|[^\w\s]", e.TEMPLATES["full"].format(specifications=text, paper="")))
    cfg = e.ExtractionConfig(max_context_tokens=1500 + fixed + 100, full_max_tokens=100)
    return e.extract_full(fx.table(spark, sf, "documents"), FIELDS, Completer(full_completer), cfg).select("doc_id", "field", "status")


@register("run_all")
def everything(spark, sf):
    plan = fx.benchmark_queries(spark, sf)
    fields = [f for f in FIELDS if f["label"] != "f4"]
    out, _ = run_all(fx.table(spark, sf, "documents").select("doc_id", "text"), plan, fields, Encoder(hashed_encoder), arithmetic_score,
                     Completer(copying_completer), per_query=10, max_fused=40)
    return out.select("doc_id", "field", "status", "confidence")


# --- wide screening export -----------------------------------------------------------------------

@register("screening_wide", fx.sql(*fx.SCREENED, fx.SQL_LABELLED, select="SELECT p.batch_id, p.\"row\", doc_title AS title, coalesce(d.decision, '') AS decision, "
          "CASE WHEN p.abstract = '' THEN 'missing_abstract' ELSE 'screened' END AS screening_status, coalesce(h.human_decision, '') AS human_decision, p.lang AS \"Language\", "
          "(coalesce(blocking_count, 0))::VARCHAR AS blocking_criteria, " + ", ".join(
              f"coalesce(max(o.criterion_decision) FILTER (o.label = '{c['label']}'), '') AS \"{c['label']} (decision)\", "
              f"coalesce(max(o.finding) FILTER (o.label = '{c['label']}'), '') AS \"{c['label']} (finding)\"" for c in fx.CRITERIA) + """
FROM (SELECT *, CASE WHEN regexp_matches(title, '^\\s*[=+@-]') THEN '''' || title ELSE title END AS doc_title FROM papers) p
LEFT JOIN decided d ON p."row" = d."row" LEFT JOIN human h ON p.doc_id = h.doc_id LEFT JOIN outcome o ON p."row" = o."row"
GROUP BY ALL"""))
def screening_export(spark, sf):
    results_with_extra = labelled(spark, sf).withColumn("extra", F.create_map(F.lit("Language"), F.col("lang")))
    out = sinks.screening_wide(results_with_extra, fx.CRITERIA)
    return out.select("batch_id", "row", "title", "decision", "screening_status", "human_decision", "Language", "blocking_criteria", *[
        F.col(f"`{c['label']} ({part})`") for c in fx.CRITERIA for part in ("decision", "finding")])


# --- provenance ----------------------------------------------------------------------------------

SETTINGS = {"chunking": {"max_tokens": 256, "min_tokens": 5}, "language": "english"}


@register("fingerprint", f"""
SELECT doc_id, sha256('index' || chr(10) || '{{"markdown":"' || sha256(text) || '","parse":"' || lang || '"}}' || chr(10) || '{pv.settings_hash(SETTINGS)}') AS fingerprint FROM documents""")
def fingerprints(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", pv.fingerprint(
        "index", {"parse": F.col("lang"), "markdown": F.sha2("text", 256)}, SETTINGS).alias("fingerprint"))


@register("output_hash", """
WITH h AS (SELECT user_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS d FROM events),
s AS (SELECT user_id, count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::UBIGINT)::VARCHAR AS p{i}" for i in range(8)) + """ FROM h GROUP BY ALL)
SELECT user_id, sha256(concat_ws('|', n::VARCHAR, """ + ", ".join(f"p{i}" for i in range(8)) + ")) AS output_hash FROM s")
def hashes(spark, sf):
    return pv.output_hash(fx.table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id")


def manifest_state(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 11 != 0).alias("has_pdf"), *[
        F.lit(f"{kind}1").alias(f"{s}_{kind}") for s in pv.STAGES for kind in ("fingerprint", "output")])
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("i")) for i, s in enumerate(pv.STAGES)])
    rows = fx.table(spark, sf, "documents").select("doc_id", F.inline(stages))
    turn = (F.col("doc_id") + F.col("i")) % 6
    manifests = rows.select(
        F.when(turn == 5, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "stage",
        F.when(turn == 4, "stale").otherwise("fingerprint1").alias("fingerprint"), F.when(turn == 3, "changed").otherwise("output1").alias("output_hash"))
    return docs, manifests


SQL_STATUS = """st AS (
  SELECT doc_id, doc_id % 11 <> 0 AS has_pdf, """ + ", ".join(f"(doc_id + {i}) % 6 < 3 AS c{i}" for i in range(5)) + """ FROM documents),
status AS (
  SELECT doc_id, has_pdf, has_pdf AND c0 AS has_parsed, has_pdf AND c0 AND c1 AS has_index, has_pdf AND c0 AND c1 AND c2 AS has_evidence,
         has_pdf AND c0 AND c1 AND c2 AND c3 AS has_extraction, has_pdf AND c0 AND c4 AS has_full_extraction FROM st)"""


@register("stage_status", fx.sql(SQL_STATUS, select="SELECT * FROM status"))
def status(spark, sf):
    return pv.stage_status(*manifest_state(spark, sf))


@register("stale_docs", fx.sql(SQL_STATUS, select="""
SELECT doc_id, false AS forced FROM status WHERE has_pdf AND NOT has_index UNION ALL SELECT doc_id, true FROM status WHERE has_pdf"""))
def stale(spark, sf):
    now = pv.stage_status(*manifest_state(spark, sf))
    return pv.stale_docs(now, "index").withColumn("forced", F.lit(False)).unionByName(
        pv.stale_docs(now, "index", force=True).withColumn("forced", F.lit(True)))


@register("plan_is_current", """
SELECT CASE WHEN count(*) > 0 THEN true END AS unchanged, false AS after_change FROM benchmark""")
def current(spark, sf):
    plan = e.config_rows(plan_rows(spark, sf))
    saved = pv.plan_identity(plan, FIELDS)
    changed = pv.plan_is_current(plan, FIELDS[1:], saved)
    return fx.table(spark, sf, "benchmark").agg(F.lit(pv.plan_is_current(plan[::-1], FIELDS, saved)).alias("unchanged"), F.lit(changed).alias("after_change"))


# --- stored runs ---------------------------------------------------------------------------------

def plain_completer():
    """Stand-in for a model whose every reply is sound: it quotes the start of the first passage for each field it is asked for."""
    def complete(system, user, max_tokens):
        source, line = re.search(r"\[(chunk_\d+)\] Section: [^\n]*\n([^\n]*)", user).groups()
        values = {"string": "x", "integer": 12, "number": 1.5}

        def field(kind):
            return {"value": values[kind], "status": "extracted", "confidence": "high", "notes": None,
                    "evidence": [{"source_id": source, "quote": line[:20].strip()}]}

        kinds = re.findall(r"Required value type: (\S+)", user)
        ids = re.findall(r"Field ID: (\S+)", user)
        return json.dumps({i: field(k) for i, k in zip(ids, kinds)} if ids else field(kinds[0]))

    return complete


@register("run_all_resumed")
def run_in_steps(spark, sf):
    """All documents, all again, and all with another output limit: what each run had to make."""
    docs, plan = fx.table(spark, sf, "documents").select("doc_id", "text"), fx.benchmark_queries(spark, sf)
    store, log = StageStore(spark, new_folder(spark, "run"), 8), CallLog(spark, new_folder(spark, "calls"))
    fields = [f for f in FIELDS if f["label"] != "f4"]
    made, calls = [], [0]
    for limit in (1024, 1024, 2048):
        run = StoredRun(store, plan, fields, Encoder(hashed_encoder), arithmetic_score, Completer(plain_completer, "plain-1"),
                        {"encoder": "hashed-1", "scorer": "arithmetic-1", "completer": "plain-1"}, extraction=e.ExtractionConfig(max_tokens=limit), log=log,
                        per_query=10, max_fused=40)
        made.append(",".join(run.run(docs)))
        calls.append(log.rows().count())
    counts = store.history().groupBy("doc_id", "stage").agg(F.count(F.lit(1)).alias("times_made"))
    return counts.withColumns({"stages_run": F.lit(";".join(made)), "calls_second": F.lit(calls[2] - calls[1]).cast("bigint"),
                               "calls_third": F.lit(calls[3] - calls[2]).cast("bigint")})
