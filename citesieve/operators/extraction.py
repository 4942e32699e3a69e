"""Query planning and typed field extraction from evidence passages.

Fields are configuration. Requests and validation are expressions on one row per (document, unit of
fields); passages of a unit travel with it as a short map, so replies are checked without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesieve.functions.json_values import (as_text, is_missing, kind_of, member, salvage_json, stringify_value,
                                             valid_value)
from citesieve.functions.models import Completer
from citesieve.functions.text import clean_text, plain_layout, python_list, quote_in_text, strip_references, token_count
from citesieve.operators.calls import CallLog, answered
from citesieve.operators.chunking import table_rows
from citesieve.session import compute_once, config_rows, literal_rows

# Fixed values.
STATUSES = ["extracted", "not_reported", "not_applicable", "unclear", "conflicting_evidence"]
CONFIDENCES = ["high", "medium", "low"]
FAILURES = ["no_evidence", "llm_failed", "invalid_output", "context_too_large"]



@dataclass(frozen=True)
class ExtractionConfig:
    single_system: str = ""
    group_system: str = ""
    full_system: str = ""
    planner_system: str = ""
    max_tokens: int = 1024
    max_group_chunks: int = 24
    max_context_tokens: int = 7800
    full_max_tokens: int = 1536


# --- prompts ---------------------------------------------------------------------------------

# The user messages, with their places in braces.
TEMPLATES = {
    "field": "Field: {label}\nDescription: {description}\nRules: {rules}\nRequired value type: {value_type}\nAllowed values: {allowed_values}",
    "field_id": "Field ID: {id}\n{specification}",
    "passage": "[{id}] Section: {section}\n{text}",
    "extract": "{specification}\n\nEvidence:\n{passages}",
    "group": "Topic group: {label}\n\nFIELDS:\n{specifications}\n\nEVIDENCE:\n{passages}",
    "full": "FIELDS:\n{specifications}\n\n--- BEGIN PAPER ---\n{paper}\n--- END PAPER ---",
    "planner_field": "Field: {label}\nRetrieval question: {description}",
}


def render_prompt(name: str, **values: Column) -> Column:
    """Fill a template with columns."""
    parts, rest = [], TEMPLATES[name]
    while "{" in rest:
        before, rest = rest.split("{", 1)
        place, rest = rest.split("}", 1)
        parts += [F.lit(before), F.coalesce(values[place].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def field_specification(field: dict) -> str:
    """The specification text of one configured field."""
    return TEMPLATES["field"].format(
        label=field["label"], description=field.get("description"), rules=field.get("rules") or "",
        value_type=field.get("value_type") or "string", allowed_values=field.get("allowed_values"))


def specification_column(fields: DataFrame) -> DataFrame:
    return fields.withColumn("specification", render_prompt(
        "field", label=F.col("label"), description=F.col("description"), rules=F.col("rules"),
        value_type=F.coalesce("value_type", F.lit("string")), allowed_values=python_list("allowed_values")))


def passage_text(chunks: DataFrame) -> Column:
    """What a prompt shows of a chunk: tables in full, other chunks as their text."""
    if "raw" not in chunks.columns:
        return F.col("text")
    return F.when((F.col("kind") == "table") & F.col("raw").isNotNull(), table_rows("raw")).otherwise(F.col("text"))


# --- plan ------------------------------------------------------------------------------------

def parse_plan(reply) -> Column:
    """ARRAY<STRUCT<label, queries, keywords>> of a planner reply: JSON, else its outermost braces; null when neither."""
    text = F.col(reply) if isinstance(reply, str) else reply
    inner = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    v = F.coalesce(F.try_parse_json(text), inner)
    entries = F.map_entries(F.try_variant_get(F.when(kind_of(v) == "OBJECT", v), "$", "map<string,variant>"))

    def texts(x: Column, key: str) -> Column:
        values = F.try_variant_get(member(x, key), "$", "array<variant>")
        return F.filter(F.transform(F.coalesce(values, F.array().cast("array<variant>")), as_text), lambda s: F.coalesce(clean_text(s) != "", F.lit(False)))

    return F.transform(F.filter(entries, lambda e: kind_of(e["value"]) == "OBJECT"), lambda e: F.struct(
        e["key"].alias("label"), texts(e["value"], "queries").alias("queries"), texts(e["value"], "keywords").alias("keywords")))


def check_plan(plan: DataFrame, fields: DataFrame, reject_unknown: bool = False) -> DataFrame:
    """Faults of a plan (label, queries, keywords): fields left out, no query, fewer than two keywords, unknown labels."""
    wanted = fields.select("label").distinct()
    missing = wanted.join(plan.select("label"), "label", "left_anti").withColumn("reject_reason", F.lit("missing_field"))
    known = plan.join(wanted, "label", "left_semi")
    thin = known.select("label", F.when(F.size("queries") < 1, "no_query").when(F.size("keywords") < 2, "too_few_keywords").alias(
        "reject_reason")).filter("reject_reason IS NOT NULL")
    out = missing.unionByName(thin)
    if reject_unknown:
        out = out.unionByName(plan.select("label").distinct().join(wanted, "label", "left_anti").withColumn("reject_reason", F.lit("unknown_field")))
    return out


def plan_queries(fields: DataFrame, completer: Completer, cfg: ExtractionConfig, batch: int = 4, retries: int = 2,
                 log: CallLog | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan (field, queries, keywords) from batches of fields, and the batches that stayed invalid.

    Fields are a configuration table; a whole batch is asked again while its reply is invalid. With
    ``log``, valid replies of earlier runs are used again.
    """
    listed = sorted(config_rows(fields), key=lambda f: (f.get("group_ord") or 0, f.get("field_ord") or 0))
    batches = [listed[i:i + batch] for i in range(0, len(listed), batch)]
    rows = [{"batch": i, "prompt": "\n\n".join(TEMPLATES["planner_field"].format(label=f["label"], description=f.get("description")) for f in b)}
            for i, b in enumerate(batches)]
    spark = fields.sparkSession
    pending = literal_rows(spark, rows, "batch INT,prompt STRING")
    labels = F.array(*[F.array(*[F.lit(f["label"]) for f in b]) for b in batches])
    good = None

    def planned(asked: DataFrame) -> DataFrame:
        parsed = compute_once(asked, {"_p": parse_plan("_r.text")})
        wanted = F.get(labels, F.col("batch"))
        used = F.transform(wanted, lambda label: F.element_at(F.filter("_p", lambda e: e["label"] == label), -1))
        parsed = compute_once(parsed, {"_used": used})
        ok = F.coalesce(F.forall("_used", lambda e: e.isNotNull() & (F.size(e["queries"]) >= 1) & (F.size(e["keywords"]) >= 2)), F.lit(False))
        return parsed.withColumn("_ok", ok)

    def fault(asked: DataFrame) -> DataFrame:
        return planned(asked).withColumn("fault", F.when(~F.col("_ok"), "incomplete plan"))

    for attempt in range(retries + 1):
        parsed = planned(answered(pending, completer, cfg.planner_system, "prompt", cfg.max_tokens, log, "plan", fault))
        done = parsed.filter("_ok").select("batch", F.inline("_used"))
        good = done if good is None else good.unionByName(done)
        pending = parsed.filter("NOT _ok").select("batch", "prompt")
        if attempt == retries or pending.isEmpty():
            break
    return good, pending.select("batch")


# --- units and passages ----------------------------------------------------------------------

def split_groups(fields: DataFrame, max_fields: int) -> DataFrame:
    """Add ``unit``: fields of a group cut into work units. The table is configuration, one group is short."""
    order = Window.partitionBy("group_ord").orderBy("field_ord")
    return fields.withColumn("unit", F.floor((F.row_number().over(order) - 1) / max_fields).cast("int"))


def group_evidence(evidence: DataFrame, fields: list[dict], max_chunks: int) -> DataFrame:
    """Passages of each unit: fields take turns by depth, the first mention of a chunk counts, up to ``max_chunks``.

    ``evidence`` is (doc_id, field, evidence_ix, chunk_ix); ``fields`` are dicts with label, unit and place.
    """
    largest = max([sum(1 for g in fields if g["unit"] == f["unit"]) for f in fields], default=0)
    if max_chunks < largest:
        raise ValueError(f"A unit of {largest} fields needs as many chunks; max_chunks allows {max_chunks}")
    known = F.create_map(*[x for f in fields for x in (F.lit(f["label"]), F.struct(F.lit(f["unit"]).alias("unit"), F.lit(f["place"]).alias("place")))])
    placed = evidence.withColumn("_f", F.element_at(known, F.col("field"))).filter("_f IS NOT NULL")
    first = placed.groupBy("doc_id", F.col("_f.unit").alias("unit"), "chunk_ix").agg(
        F.min(F.struct(F.col("evidence_ix").alias("depth"), F.col("_f.place").alias("place"))).alias("_turn"))
    order = Window.partitionBy("doc_id", "unit").orderBy("_turn", "chunk_ix")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_chunks).select(
        "doc_id", "unit", "chunk_ix", "place")


def unit_passages(selected: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., passages, sources): the prompt text of the passages in place order, and the map from id to text."""
    shown = chunks.select("doc_id", "chunk_ix", "section", passage_text(chunks).alias("passage"))
    text = selected.join(shown, ["doc_id", "chunk_ix"])
    ident = F.concat(F.lit("chunk_"), F.col("chunk_ix"))
    listed = text.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        "place", ident.alias("id"), "section", "passage"))).alias("_p"))
    rendered = F.transform("_p", lambda p: render_prompt("passage", id=p["id"], section=p["section"], text=p["passage"]))
    return listed.select(*by, F.array_join(rendered, "\n\n").alias("passages"),
                         F.map_from_entries(F.transform("_p", lambda p: F.struct(p["id"], p["passage"]))).alias("sources"))


# --- validation ------------------------------------------------------------------------------

def field_errors(v: Column, value_type: Column, allowed: Column, full: bool = False) -> Column:
    """Rules a field object breaks, as an array of codes; empty when it is sound."""
    value, evidence, notes = member(v, "value"), member(v, "evidence"), member(v, "notes")
    status, confidence = as_text(member(v, "status")), as_text(member(v, "confidence"))
    has_value = ~is_missing(value)
    items = F.try_variant_get(evidence, "$", "array<variant>")
    values = F.when(kind_of(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    rules = [
        F.when(kind_of(v).isNull() | (kind_of(v) != "OBJECT"), "not_an_object"),
        F.when(value.isNull() | member(v, "status").isNull() | member(v, "confidence").isNull(), "missing_properties"),
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "invalid_status"),
        F.when(~F.coalesce(confidence.isin(*CONFIDENCES), F.lit(False)), "invalid_confidence"),
        F.when(_truthy(member(v, "error")) | _truthy(member(v, "validation_errors")), "contains_errors"),
        F.when(~is_missing(notes) & (kind_of(notes) != "STRING"), "notes_not_text"),
        F.when(has_value & ~F.coalesce(valid_value(value, value_type), F.lit(False)), "wrong_type"),
        F.when((status == "extracted") & ~has_value, "value_required"),
        F.when(status.isin("not_reported", "not_applicable") & has_value, "value_must_be_null"),
        F.when(has_value & (F.size(allowed) > 0) & F.exists(values, lambda x: ~F.coalesce(
            F.array_contains(allowed, F.coalesce(as_text(x), F.lit("\x00"))), F.lit(False))), "outside_allowed_values"),
    ]
    if full:
        quote, section = member(v, "source_quote"), member(v, "source_section")
        rules += [
            F.when(quote.isNull() | (~is_missing(quote) & (kind_of(quote) != "STRING")), "quote_not_text"),
            F.when((status == "extracted") & (F.coalesce(clean_text(as_text(quote)), F.lit("")) == ""), "quote_required"),
            F.when(~is_missing(section) & (kind_of(section) != "STRING"), "section_not_text")]
    else:
        def broken(x: Column) -> Column:
            return (F.coalesce(clean_text(as_text(member(x, "source_id"))), F.lit("")) == "") | (
                F.coalesce(clean_text(as_text(member(x, "quote"))), F.lit("")) == "")

        listed = F.coalesce(kind_of(evidence) == "ARRAY", F.lit(False))
        rules += [
            F.when(~listed, "evidence_not_a_list").when(F.exists(items, broken), "evidence_without_source_or_quote"),
            F.when((status == "extracted") & (~listed | (F.size(items) == 0)), "evidence_required")]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def _truthy(v: Column) -> Column:
    kind = kind_of(v)
    empty = F.try_variant_get(v, "$", "string").isin("", "false", "0", "[]", "{}", "0.0")
    return F.coalesce(kind.isNotNull() & (kind != "VOID") & ~empty, F.lit(False))


def evidence_items(v: Column) -> Column:
    """(source_id, quote) of the evidence entries of a field object."""
    items = F.try_variant_get(member(v, "evidence"), "$", "array<variant>")
    return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.struct(
        as_text(member(x, "source_id")).alias("source_id"), as_text(member(x, "quote")).alias("quote")))


def plain_sources(sources) -> Column:
    """Passages in the form in which quotes are looked up. Made once per unit of fields, not once per field and quote."""
    return F.transform_values(sources, lambda _, passage: F.when(passage.isNotNull(), plain_layout(passage)))


def check_evidence(items: Column, sources: Column, plain: bool = False) -> Column:
    """Each entry with its fault: unknown source, missing quote, or a quote that its passage does not hold.

    ``plain`` sources went through :func:`plain_sources`.
    """
    def judged(x: Column) -> Column:
        passage = F.element_at(sources, x["source_id"])
        fault = (F.when(x["source_id"].isNull() | passage.isNull(), "unknown_source")
                 .when(F.coalesce(clean_text(x["quote"]), F.lit("")) == "", "missing_quote")
                 .when(~quote_in_text(x["quote"], passage, plain), "quote_not_in_source"))
        return F.struct(x["source_id"].alias("source_id"), F.trim(x["quote"]).alias("quote"), fault.alias("fault"))

    return F.transform(items, judged)


def validate_fields(df: DataFrame, full: bool = False) -> DataFrame:
    """Turn the field object ``raw`` (VARIANT) into a checked result.

    Needs ``value_type`` and ``allowed_values``, and ``sources`` (map) or, for full texts, ``paper``. ``plain_sources``
    and ``plain_paper``, if they are there, are those texts in the form in which quotes are looked up.
    """
    v = F.col("raw")
    errors = field_errors(v, F.col("value_type"), F.coalesce("allowed_values", F.array().cast("array<string>")), full)
    if full:
        quote = as_text(member(v, "source_quote"))
        absent = F.when((F.coalesce(clean_text(quote), F.lit("")) != "") & ~quote_in_text(
            quote, *(("plain_paper", True) if "plain_paper" in df.columns else ("paper",))), F.array(F.lit("quote_not_in_paper")))
        judged = F.when(F.coalesce(clean_text(quote), F.lit("")) != "", F.array(F.struct(
            F.lit("paper").alias("source_id"), quote.alias("quote"), F.lit(None).cast("string").alias("fault")))).otherwise(
            F.array().cast("array<struct<source_id:string,quote:string,fault:string>>"))
        df = compute_once(df, {"_errors": F.concat(errors, F.coalesce(absent, F.array().cast("array<string>"))), "_judged": judged})
    else:
        df = compute_once(df, {"_errors": errors, "_judged": check_evidence(
            evidence_items(v), *((F.col("plain_sources"), True) if "plain_sources" in df.columns else (F.col("sources"),)))})
        faults = F.transform(F.filter("_judged", lambda x: x["fault"].isNotNull()), lambda x: x["fault"])
        df = df.withColumn("_errors", F.concat("_errors", faults))
    sound = F.size("_errors") == 0
    good = F.transform(F.filter("_judged", lambda x: x["fault"].isNull()), lambda x: F.struct(x["source_id"], x["quote"]))
    return df.withColumns({
        "value": F.when(sound, member(v, "value")), "status": F.when(sound, as_text(member(v, "status"))).otherwise("invalid_output"),
        "confidence": F.when(sound, as_text(member(v, "confidence"))).otherwise("low"),
        "evidence": good, "notes": as_text(member(v, "notes")), "error": F.lit(None).cast("string"),
        "validation_errors": F.col("_errors"), "raw_output": F.when(~sound, v)}).drop("_errors", "_judged", "raw")


def failure(df: DataFrame, status, error=None) -> DataFrame:
    """Results of fields that got no usable reply."""
    return df.withColumns({
        "value": F.lit(None).cast("variant"), "status": F.lit(status) if isinstance(status, str) else status, "confidence": F.lit("low"),
        "evidence": F.array().cast("array<struct<source_id:string,quote:string>>"), "notes": F.lit(None).cast("string"),
        "error": F.lit(None).cast("string") if error is None else error, "validation_errors": F.array().cast("array<string>"),
        "raw_output": F.lit(None).cast("variant")})


COLUMNS = ["doc_id", "field", "value", "status", "confidence", "evidence", "notes", "error", "validation_errors", "raw_output"]


def _field_rows(fields: list[dict]) -> Column:
    """Fields of a unit as an array literal keyed by unit."""
    units = sorted({f["unit"] for f in fields})
    return F.create_map(*[x for u in units for x in (F.lit(u), F.array(*[F.struct(
        F.lit(f["label"]).alias("field"), F.lit(f["id"]).alias("field_id"), F.lit(f.get("value_type") or "string").alias("value_type"),
        F.array(*[F.lit(a) for a in (f.get("allowed_values") or [])]).cast("array<string>").alias("allowed_values"),
        F.lit(field_specification(f)).alias("specification")) for f in fields if f["unit"] == u]))])


def with_units(fields: list[dict], max_fields: int) -> list[dict]:
    """Configured fields with ``unit`` and ``place``; ``group`` and order come from the field table."""
    out, unit, inside, group = [], -1, 0, object()
    for f in fields:
        if f.get("group") != group or inside == max_fields:
            unit, inside, group = unit + 1, 0, f.get("group")
        out.append({**f, "unit": unit, "place": inside})
        inside += 1
    return out


def no_object(asked: DataFrame) -> DataFrame:
    """The fault of a reply that holds no JSON object; what its fields lack is asked for again field by field."""
    return asked.withColumn("fault", F.when(salvage_json("_r.text").isNull(), "reply holds no JSON object"))


def extract_groups(evidence: DataFrame, chunks: DataFrame, docs: DataFrame, fields: list[dict], completer: Completer,
                   cfg: ExtractionConfig = ExtractionConfig(), log: CallLog | None = None) -> DataFrame:
    """Field results of all documents: one call per (document, unit), and faulty fields asked again alone.

    Fields without evidence end as ``no_evidence`` without a call; a failing call harms its fields
    only. With ``log``, replies of earlier runs are used again; only fields that stayed invalid are asked for anew.
    """
    units = with_units(fields, cfg.max_group_chunks)
    passages = unit_passages(group_evidence(evidence, units, cfg.max_group_chunks), chunks, ["doc_id", "unit"])
    work = docs.select("doc_id", F.explode(F.array(*[F.lit(u) for u in sorted({f["unit"] for f in units})])).alias("unit"))
    work = work.join(passages, ["doc_id", "unit"], "left")
    specs = F.create_map(*[x for u in sorted({f["unit"] for f in units}) for x in (F.lit(u), F.lit(TEMPLATES["group"].format(
        label=next(f.get("group") or "" for f in units if f["unit"] == u), specifications="\n\n".join(
            TEMPLATES["field_id"].format(id=f["id"], specification=field_specification(f)) for f in units if f["unit"] == u),
        passages="")))])
    prompt = F.concat(F.element_at(specs, F.col("unit")), "passages")

    def read(asked: DataFrame) -> DataFrame:
        replies = compute_once(asked, {"_v": F.when(F.col("_r.error").isNull(), F.try_variant_get(salvage_json("_r.text"), "$", "map<string,variant>")),
                                       "plain_sources": plain_sources("sources")})
        listed = replies.select("doc_id", "plain_sources", "_v", F.inline(F.element_at(_field_rows(units), F.col("unit"))))
        raw = F.element_at("_v", F.col("field_id"))
        return validate_fields(listed.withColumn("raw", F.when(kind_of(raw) == "OBJECT", raw))).select(*COLUMNS)

    checked = answered(work.filter("passages IS NOT NULL").withColumn("_prompt", prompt), completer, cfg.group_system, "_prompt", cfg.max_tokens, log,
                       "extract_groups", no_object, read)
    nothing = failure(work.filter("passages IS NULL").select("doc_id", F.inline(F.element_at(_field_rows(units), F.col("unit")))), "no_evidence")
    retried = retry_invalid_fields(checked, evidence, chunks, fields, completer, cfg, log)
    return checked.filter("status <> 'invalid_output'").unionByName(retried).unionByName(nothing.select(*COLUMNS))


def retry_invalid_fields(results: DataFrame, evidence: DataFrame, chunks: DataFrame, fields: list[dict], completer: Completer,
                         cfg: ExtractionConfig = ExtractionConfig(), log: CallLog | None = None) -> DataFrame:
    """Ask every invalid field again alone, with its own evidence."""
    todo = results.filter("status = 'invalid_output'").select("doc_id", "field")
    return extract_each(evidence, chunks, todo, fields, completer, cfg, log)


def extract_each(evidence: DataFrame, chunks: DataFrame, todo: DataFrame, fields: list[dict], completer: Completer,
                 cfg: ExtractionConfig = ExtractionConfig(), log: CallLog | None = None) -> DataFrame:
    """One call per (document, field) of ``todo``. A logged reply is used again if its field was valid."""
    own = evidence.join(todo, ["doc_id", "field"], "left_semi").groupBy("doc_id", "field", "chunk_ix").agg(
        F.min("evidence_ix").alias("place"))
    passages = unit_passages(own, chunks, ["doc_id", "field"])
    work = todo.join(passages, ["doc_id", "field"], "left")
    specs = F.create_map(*[x for f in fields for x in (F.lit(f["label"]), F.struct(
        F.lit(f.get("value_type") or "string").alias("value_type"),
        F.array(*[F.lit(a) for a in (f.get("allowed_values") or [])]).cast("array<string>").alias("allowed_values"),
        F.lit(TEMPLATES["extract"].format(specification=field_specification(f), passages="")).alias("prompt")))])
    work = work.withColumn("_f", F.element_at(specs, F.col("field")))

    def read(asked: DataFrame) -> DataFrame:
        replies = compute_once(asked, {"raw": F.when(F.col("_r.error").isNull(), salvage_json("_r.text"))})
        return replies.withColumns({"value_type": F.col("_f.value_type"), "allowed_values": F.col("_f.allowed_values")})

    def fault(asked: DataFrame) -> DataFrame:
        judged = validate_fields(read(asked).drop("error")).withColumn("_why", F.array_join("validation_errors", ","))
        return judged.withColumn("fault", F.when(F.col("status") == "invalid_output", F.coalesce("_why", F.lit("invalid"))))

    def results(asked: DataFrame) -> DataFrame:
        replies = read(asked).withColumns({"_failed": F.col("raw").isNull(), "_why": F.coalesce("_r.error", F.lit("reply holds no JSON object"))})
        return validate_fields(replies).select(*COLUMNS, "_failed", "_why")

    checked = answered(work.filter("passages IS NOT NULL").withColumn("_prompt", F.concat("_f.prompt", "passages")), completer, cfg.single_system, "_prompt",
                       cfg.max_tokens, log, "extract_each", fault, results)
    failed = checked.filter("_failed").select("doc_id", "field", "_why")
    return (checked.filter("NOT _failed").select(*COLUMNS)
            .unionByName(failure(failed, "llm_failed", F.col("_why")).select(*COLUMNS))
            .unionByName(failure(work.filter("passages IS NULL"), "no_evidence").select(*COLUMNS)))


def extract_full(docs: DataFrame, fields: list[dict], completer: Completer, cfg: ExtractionConfig = ExtractionConfig(),
                 counter=token_count, log: CallLog | None = None) -> DataFrame:
    """One call per document over its whole text without references; texts beyond the budget are not truncated.

    With ``log``, replies of earlier runs whose fields all were valid are used again.
    """
    specs = "\n\n".join(field_specification(f) for f in fields)
    prompt = render_prompt("full", specifications=F.lit(specs), paper=F.col("paper"))
    listed = with_units(fields, max(len(fields), 1))
    rows = F.array(*[F.struct(
        F.lit(f["label"]).alias("field"), F.lit(f.get("value_type") or "string").alias("value_type"),
        F.array(*[F.lit(a) for a in (f.get("allowed_values") or [])]).cast("array<string>").alias("allowed_values")) for f in listed])
    work = compute_once(docs.select("doc_id", strip_references("text").alias("paper")), {"prompt": prompt})
    need = counter(F.lit(cfg.full_system)) + counter(F.col("prompt")) + cfg.full_max_tokens
    work = compute_once(work, {"request_tokens": need})
    fits = F.col("request_tokens") <= cfg.max_context_tokens

    def fault(asked: DataFrame) -> DataFrame:
        read = compute_once(asked, {"_v": F.try_variant_get(salvage_json("_r.text"), "$", "map<string,variant>"), "_plain": plain_layout("paper")})

        def unsound(f: Column) -> Column:
            raw = F.element_at("_v", f["field"])
            quote = as_text(member(raw, "source_quote"))
            absent = (F.coalesce(clean_text(quote), F.lit("")) != "") & ~quote_in_text(quote, "_plain", True)
            return (F.size(field_errors(raw, f["value_type"], f["allowed_values"], True)) > 0) | absent

        return read.withColumn("fault", F.when(F.col("_v").isNull(), "reply holds no JSON object").when(F.exists(rows, unsound), "invalid fields")).drop("_v", "_plain")

    asked = answered(work.filter(fits), completer, cfg.full_system, "prompt", cfg.full_max_tokens, log, "extract_full", fault).drop("prompt")
    replies = compute_once(asked, {"_v": F.when(F.col("_r.error").isNull(), F.try_variant_get(salvage_json("_r.text"), "$", "map<string,variant>"))})
    good = compute_once(replies.filter("_v IS NOT NULL").select("doc_id", "paper", "_v"), {"plain_paper": plain_layout("paper")})
    good = good.select("doc_id", "plain_paper", "_v", F.inline(rows))
    checked = validate_fields(good.withColumn("raw", F.element_at("_v", F.col("field"))), full=True)
    error = F.coalesce("_r.error", F.lit("reply holds no JSON object"))
    failed = failure(replies.filter("_v IS NULL").select("doc_id", "_r", F.inline(rows)), "llm_failed", error)
    message = F.concat(F.lit("request needs about "), "request_tokens", F.lit(f" tokens, the limit is {cfg.max_context_tokens}"))
    large = failure(work.filter(~fits).select("doc_id", "request_tokens", F.inline(rows)), "context_too_large", message)
    return checked.select(*COLUMNS).unionByName(failed.select(*COLUMNS)).unionByName(large.select(*COLUMNS))


def reuse_valid_fields(todo: DataFrame, prior: DataFrame, fingerprint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields still to extract, and earlier results of the same fingerprint that are valid.

    The fingerprint is one for all, or a column of ``todo``.
    """
    keys = ["doc_id", "field"] + ([] if fingerprint else ["fingerprint"])
    valid = prior.filter(F.col("status").isin(*STATUSES) & (F.lit(True) if fingerprint is None else F.col("fingerprint") == fingerprint))
    return todo.join(valid.select(*keys), keys, "left_anti"), valid.join(todo.select(*keys), keys, "left_semi")


def _completeness(fields: list[dict]) -> tuple[list[Column], Column]:
    """Aggregates over the results of a document, and what they say of it: exactly the configured fields, each valid."""
    labels = [f["label"] for f in fields]
    valid = F.col("field").isin(*labels) & F.col("status").isin(*STATUSES) & (F.size("validation_errors") == 0)
    good = F.size(F.collect_set(F.when(valid, F.col("field")))).alias("_good")
    complete = (F.col("_good") == len(labels)) & (F.col("_n") == len(labels)) & F.lit(bool(labels))
    return [good, F.count(F.lit(1)).alias("_n")], complete


def extraction_complete(results: DataFrame, fields: list[dict]) -> DataFrame:
    """(doc_id, complete): exactly the configured fields, each valid."""
    counts, complete = _completeness(fields)
    return results.groupBy("doc_id").agg(*counts).select("doc_id", complete.alias("complete"))


def extraction_long(docs: DataFrame, results: DataFrame, fields: list[dict], only_complete: bool = True) -> DataFrame:
    """(doc_id, label, value, status, confidence, quotes, error) for every document and field; unfinished documents are blank.

    The results of a document, a few rows, are gathered once; they say whether it is complete and fill its fields.
    """
    quotes = F.filter(F.transform("evidence", lambda e: e["quote"]), lambda q: q != "")
    cell = F.struct("field", stringify_value("value").alias("value"), "status", "confidence",
                    F.coalesce(quotes, F.array().cast("array<string>")).alias("quotes"), "error")
    judged = ["validation_errors"] if only_complete else []
    cells = results.select("doc_id", "field", "status", *judged, cell.alias("_cell"))
    counts, complete = _completeness(fields) if only_complete else ([], F.lit(True))
    gathered = cells.groupBy("doc_id").agg(F.collect_list("_cell").alias("_cells"), *counts).select("doc_id", F.when(complete, F.col("_cells")).alias("_cells"))
    grid = docs.select("doc_id").join(gathered, "doc_id", "left").select("doc_id", "_cells", F.explode(F.array(*[F.lit(f["label"]) for f in fields])).alias("label"))
    joined = grid.select("doc_id", "label", F.explode_outer(F.filter("_cells", lambda c: c["field"] == F.col("label"))).alias("_c"))
    return joined.select("doc_id", "label", "_c.value", "_c.status", "_c.confidence",
                         F.coalesce("_c.quotes", F.array().cast("array<string>")).alias("quotes"), "_c.error")
