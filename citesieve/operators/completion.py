"""Criterion screening with a completion model.

One request per paper and criterion (or per paper). Replies are checked by Spark; only the call
itself is a Python function. Criteria are asked in turn, of the papers that no earlier call failed.
Calls are written once (to a call log, if there is one), so no later step repeats them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesieve.functions.json_values import as_number, as_text, is_missing, kind_of, member, strict_json
from citesieve.functions.models import Completer
from citesieve.functions.text import clean_text
from citesieve.operators.calls import REPLY, CallLog, answered
from citesieve.operators.screening import (CLASSES, KEYS, decide, nest_criteria, pair_papers_criteria, route_unprocessed,
                                           unprocessed_columns)
from citesieve.session import compute_once, cut_lineage


@dataclass(frozen=True)
class CompletionConfig:
    system: str = ""
    mode: str = "per_criterion"
    allow_uncertainty: bool = False
    include_reason: bool = True
    extract_evidence: bool = False
    include_confidence_score: bool = False
    context_tokens: int = 8192
    max_output_tokens: int = 512
    template_token_reserve: int = 256
    request_overhead_bytes: int = 0
    response_retries: int = 1
    output_token_retry_multiplier: float = 2.0

    @property
    def keys(self) -> list[str]:
        return ["decision"] + [k for k, on in [("reason", self.include_reason), ("quote", self.extract_evidence),
                                               ("confidence", self.include_confidence_score)] if on]

    @property
    def choices(self) -> list[str]:
        return ["yes", "no"] + (["uncertain"] if self.allow_uncertainty and self.mode == "per_criterion" else [])

    @property
    def input_budget(self) -> int:
        return self.context_tokens - self.max_output_tokens - self.template_token_reserve


# --- requests --------------------------------------------------------------------------------

def request_payload(criteria: Column, assessments: Column | None = None) -> Column:
    """JSON of criteria, title and abstract, and of earlier assessments when a judge is asked."""
    parts = [criteria.alias("criteria"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract")]
    if assessments is not None:
        parts.append(assessments.alias("reviewer_assessments"))
    return F.to_json(F.struct(*parts))


def complete_requests(papers: DataFrame, criteria: list[dict], cfg: CompletionConfig) -> DataFrame:
    """(keys, ord, label, statement, type, explicit_evidence_required, title, abstract, payload)."""
    if cfg.mode == "all_criteria":
        listed = F.array(*[F.struct(F.lit(c["statement"]).alias("statement"), F.lit(c["type"]).alias("type"), F.lit(
            bool(c.get("explicit_evidence_required", False))).alias("explicit_evidence_required")) for c in criteria])
        return papers.withColumns({"ord": F.lit(0), "payload": request_payload(listed)})
    pairs = pair_papers_criteria(papers, criteria)
    return pairs.withColumn("payload", request_payload(F.array(F.struct("statement"))))


def check_budget(requests: DataFrame, cfg: CompletionConfig) -> DataFrame:
    """Add ``input_bytes`` and ``too_long``: more bytes than the context leaves for input. Nothing is truncated."""
    size = F.octet_length("payload") + cfg.request_overhead_bytes
    return requests.withColumn("input_bytes", size).withColumn("too_long", F.col("input_bytes") > cfg.input_budget)


# --- replies ---------------------------------------------------------------------------------

def sanitize_confidence(c: Column) -> Column:
    """A finite confidence outside [0, 1] becomes null instead of an error."""
    return F.when(c.between(0, 1), c)


def verbatim_quote(quote: Column) -> Column:
    """The quote is not blank and occurs exactly in title or abstract."""
    inside = F.contains(F.coalesce("title", F.lit("")), quote) | F.contains(F.coalesce("abstract", F.lit("")), quote)
    return (clean_text(quote) != "") & inside


def check_contract(replies: DataFrame, cfg: CompletionConfig) -> DataFrame:
    """Add the reply's fields and ``reply_error`` (null when the reply keeps the contract).

    ``text`` is the reply. Exactly the configured keys must be there.
    """
    df = compute_once(replies, {"_v": strict_json("text")})
    v = F.col("_v")
    decision, reason = as_text(member(v, "decision")), as_text(member(v, "reason"))
    quote, confidence = member(v, "quote"), member(v, "confidence")
    expected = F.array(*[F.lit(k) for k in sorted(cfg.keys)])
    rules = [
        F.when(v.isNull(), "not_strict_json"),
        F.when(kind_of(v) != "OBJECT", "not_an_object"),
        F.when(F.array_sort(F.json_object_keys("text")) != expected, "unexpected_or_missing_keys"),
        F.when(~F.coalesce(decision.isin(*cfg.choices), F.lit(False)), "invalid_decision")]
    if cfg.include_reason:
        rules.append(F.when(F.coalesce(clean_text(reason), F.lit("")) == "", "blank_reason"))
    if cfg.extract_evidence:
        rules.append(F.when(~is_missing(quote) & as_text(quote).isNull(), "quote_not_text"))
        rules.append(F.when(~is_missing(quote) & ~F.coalesce(verbatim_quote(as_text(quote)), F.lit(False)), "quote_not_verbatim"))
    if cfg.include_confidence_score:
        rules.append(F.when(~is_missing(confidence) & as_number(confidence).isNull(), "confidence_not_a_number"))
    return df.withColumns({
        "reply_decision": decision, "reply_reason": reason if cfg.include_reason else F.lit(None).cast("string"),
        "reply_quote": as_text(quote) if cfg.extract_evidence else F.lit(None).cast("string"),
        "reply_confidence": sanitize_confidence(as_number(confidence)) if cfg.include_confidence_score else F.lit(None).cast("double"),
        "reply_error": F.coalesce(*rules)}).drop("_v")


def classify_error(completion: Column, error: Column, reply_error: Column) -> Column:
    """Screening status of one call from the end of the completion, the call's error and the reply's fault."""
    message = F.lower(F.coalesce(error, F.lit("")))
    context = F.contains(message, F.lit("context")) & message.rlike("exceed|length|full")
    return (F.when(error.isNotNull(), F.when(context, "input_too_long").otherwise("screening_failed"))
            .when(completion == "output_limit", "output_too_long")
            .when((completion != "complete") | reply_error.isNotNull(), "screening_failed").otherwise("screened"))


def call_fault() -> Column:
    """Why a reply cannot be used: the call's error, its end, or the contract; null when it can."""
    return F.coalesce("error", F.when(F.col("completion") == "output_limit", "output limit reached"), F.when(
        F.col("completion") != "complete", F.concat(F.lit("completion "), "completion")), "reply_error")


def ask(requests: DataFrame, completer: Completer, cfg: CompletionConfig, log: CallLog | None = None, texts: DataFrame | None = None) -> DataFrame:
    """One call per request with its own ``output_budget``, written once; requests that the log has a sound reply to are not sent.

    With ``texts`` (and a log) requests come without their payload but with its ``_key``.
    """
    def fault(asked: DataFrame) -> DataFrame:
        judged = check_contract(asked.select(*[c for c in asked.columns if c != "_r"], "_r", "_r.*"), cfg)
        return judged.withColumn("fault", call_fault()).drop(*REPLY)

    purpose = f"screening/{settings_of(cfg)}"
    if texts is not None:
        asked = log.answer_keyed(requests, texts, KEYS, completer, cfg.system, F.col("payload"), "output_budget", purpose, fault)
    else:
        asked = answered(requests, completer, cfg.system, "payload", F.col("output_budget"), log, purpose, fault)
    return asked.select(*requests.columns, "_r.*", "cache_hit")


def settings_of(cfg: CompletionConfig) -> str:
    """What of the configuration decides whether a reply keeps the contract."""
    return ",".join([cfg.mode, *cfg.keys, *cfg.choices])


def retry_invalid(requests: DataFrame, completer: Completer, cfg: CompletionConfig, log: CallLog | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Ask, check, and ask the faulty ones again, at most ``response_retries`` times.

    After an output limit the budget grows by the multiplier up to the room the context leaves.
    Errors of the call itself are final. ``attempts`` keeps every reply and fault.
    """
    attempts = "array<struct<response:string,error:string,output_token_budget:int>>"
    pending = requests.withColumns({"output_budget": F.lit(cfg.max_output_tokens), "attempts": F.array().cast(attempts)})
    room = F.lit(cfg.context_tokens - cfg.template_token_reserve) - F.col("input_bytes")
    finished = []
    for attempt in range(cfg.response_retries + 1):
        asked = check_contract(ask(pending, completer, cfg, log, texts), cfg).withColumn("_fault", call_fault())
        asked = asked.withColumn("attempts", F.concat("attempts", F.array(F.struct(
            F.col("text").alias("response"), F.col("_fault").alias("error"), F.col("output_budget").alias("output_token_budget")))))
        # Rows without their texts are written once; what follows reads them, and not the log and the papers again.
        asked = cut_lineage(asked) if texts is not None and not cfg.extract_evidence else asked
        grown = F.least(F.floor(F.col("output_budget") * cfg.output_token_retry_multiplier).cast("int"), room.cast("int"))
        limited = F.col("completion") == "output_limit"
        again = (F.col("_fault").isNotNull() & F.col("error").isNull() & (~limited | (grown > F.col("output_budget")))
                 & F.lit(attempt < cfg.response_retries))
        asked = asked.withColumn("_again", again)
        finished.append(asked.filter("NOT _again").drop("_again"))
        if attempt == cfg.response_retries:
            break
        waiting = asked.filter("_again")
        if waiting.isEmpty():
            break
        pending = waiting.withColumn("output_budget", F.when(limited, grown).otherwise(F.col("output_budget"))).select(*pending.columns)
    out = reduce(DataFrame.unionByName, finished)
    return out.withColumns({
        "call_status": classify_error(F.col("completion"), F.col("error"), F.col("reply_error")),
        "call_reason": F.col("_fault")}).drop("_fault")


# --- findings --------------------------------------------------------------------------------

def map_findings(calls: DataFrame) -> DataFrame:
    """Finding and criterion decision of yes, no and uncertain replies."""
    include, reply = F.col("type") == "include", F.col("reply_decision")
    found = F.when(reply == "yes", "supported").when(reply == "no", "contradicted").otherwise("uncertain")
    decision = (F.when(reply == "yes", F.when(include, "passed").otherwise("hit"))
                .when(reply == "no", F.when(include, "failed").otherwise("cleared"))
                .otherwise(F.when(include & F.col("explicit_evidence_required"), "failed").otherwise("unresolved")))
    return calls.withColumns({"finding": found, "criterion_decision": decision})


def first_failure(calls: DataFrame) -> DataFrame:
    """Drop the criteria after a paper's first call that was not screened; that call decides the paper.

    A paper has as many rows as there are criteria, so its window is short.
    """
    failed = F.min(F.when(F.col("call_status") != "screened", F.col("ord"))).over(Window.partitionBy(*KEYS))
    return calls.withColumn("_f", failed).filter("_f IS NULL OR ord <= _f").drop("_f")


def call_audit(calls: DataFrame) -> DataFrame:
    """Per paper: calls, cache hits, time and tokens of the calls that were made."""
    fresh = ~F.coalesce(F.col("cache_hit"), F.lit(False))
    return calls.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~fresh).alias("cache_hits"),
        F.coalesce(F.sum(F.when(fresh, F.col("elapsed_seconds"))), F.lit(0.0)).alias("elapsed_seconds"),
        F.sum(F.when(fresh, F.col("input_tokens"))).alias("input_tokens"), F.sum(F.when(fresh, F.col("output_tokens"))).alias("output_tokens"))


REDO = ["screening_failed", "output_too_long"]


def resume(todo: DataFrame, done: DataFrame, fingerprint: str, keys: list[str] = KEYS, status: str = "screening_status") -> tuple[DataFrame, DataFrame]:
    """Rows still to do, and finished results of the same fingerprint; failed ones are done again."""
    kept = done.filter((F.col("fingerprint") == fingerprint) & ~F.col(status).isin(*REDO))
    reused = kept.join(todo.select(*keys), keys, "left_semi")
    return todo.join(kept.select(*keys), keys, "left_anti"), reused


RESULT = ["screening_status", "reason", "decision", "decision_confidence", "review_group", "group_rank", "blocking_count", "score_gap"]


def screen_completer(papers: DataFrame, criteria: list[dict], completer: Completer, cfg: CompletionConfig,
                     log: CallLog | None = None) -> tuple[DataFrame, DataFrame]:
    """Results (every paper once) and the table of calls. With ``log``, sound replies of earlier runs are used again."""
    eligible, rest = route_unprocessed(papers, criteria)
    if not criteria:
        return rest.withColumn("criteria", F.array()), rest.limit(0)
    if cfg.mode == "all_criteria":
        calls = call_once(complete_requests(eligible, criteria, cfg), completer, cfg, log)
        results = paper_replies(calls)
    else:
        calls = call_in_turn(eligible, criteria, completer, cfg, log)
        results = criterion_replies(calls)
    joined = papers.join(results, KEYS, "left")
    routed = rest.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in RESULT])
    joined = joined.join(routed, KEYS, "left")
    empty = F.array().cast(results.schema["criteria"].dataType)
    return joined.select(*papers.columns, *[F.coalesce(c, f"_{c}").alias(c) for c in RESULT],
                         F.coalesce("criteria", empty).alias("criteria"), F.lit("llm").alias("backend")), calls


def call_once(requests: DataFrame, completer: Completer, cfg: CompletionConfig, log: CallLog | None = None, due: DataFrame | None = None) -> DataFrame:
    """Every request that fits its budget is asked; the others end as ``input_too_long``. Texts and requests stay behind.

    ``due`` (with a log) are the keys of the papers to ask about. Keys of requests are made where the
    papers are read, so a text is dealt only when its request is sent.
    """
    sized, texts = check_budget(requests, cfg), None
    if log:
        texts = sized
        # A quote is looked up in the texts, so they come along if quotes are asked for.
        sized = sized.withColumn("_key", F.sha2("payload", 256)).drop("payload", *([] if cfg.extract_evidence else ["title", "abstract"]))
        sized = sized if due is None else sized.join(due, KEYS, "left_semi")
        sized = sized if cfg.extract_evidence else cut_lineage(sized)
    asked = retry_invalid(sized.filter("NOT too_long"), completer, cfg, log, texts).drop("_key")
    over = sized.filter("too_long").drop("_key").withColumns({
        "call_status": F.lit("input_too_long"), "call_reason": F.lit("input budget exceeded; nothing was truncated"), "cache_hit": F.lit(False)})
    return cut_lineage(asked.unionByName(over, allowMissingColumns=True).drop("title", "abstract", "payload"))


def call_in_turn(papers: DataFrame, criteria: list[dict], completer: Completer, cfg: CompletionConfig, log: CallLog | None = None) -> DataFrame:
    """One pass per criterion over the papers whose earlier calls all were screened.

    A paper leaves at its first call that was not, so no call is made that cannot count. Between
    passes only the keys of the papers that go on are kept.
    """
    calls, going, passed = None, papers, None
    for place in range(len(criteria)):
        one = complete_requests(going, criteria, cfg).filter(F.col("ord") == place)
        asked = call_once(one, completer, cfg, log, passed)
        calls = asked if calls is None else calls.unionByName(asked)
        passed = asked.filter("call_status = 'screened'").select(*KEYS)
        if place + 1 < len(criteria) and passed.isEmpty():
            break
        going = papers if log else papers.join(passed, KEYS, "left_semi")
    return calls


def criterion_replies(calls: DataFrame) -> DataFrame:
    """Paper results from per-criterion calls."""
    used = first_failure(calls)
    null = F.lit(None).cast("double")
    found = map_findings(used).withColumns({**{c: null for c in CLASSES}, "confidence": null})
    found = found.select(
        *KEYS, "ord", "label", "statement", "type", "explicit_evidence_required", *CLASSES, "confidence", "finding", "criterion_decision",
        F.col("reply_reason").alias("reason"), F.col("reply_quote").alias("quote"), F.col("reply_confidence").alias("model_confidence"),
        "call_status", "call_reason")
    nested = nest_criteria(found)
    bad = F.get(F.filter("criteria", lambda c: c["call_status"] != "screened"), F.lit(0))
    nested = nested.withColumns({"_status": F.coalesce(bad["call_status"], F.lit("screened")), "_why": bad["call_reason"]})
    nested = nested.withColumn("criteria", F.when(F.col("_status") == "screened", F.transform(
        "criteria", lambda c: c.dropFields("call_status", "call_reason"))))
    decided = decide(nested)
    return decided.select(*KEYS, F.col("_status").alias("screening_status"), F.coalesce("reason", "_why").alias("reason"),
                          *RESULT[2:], "criteria")


def paper_replies(calls: DataFrame) -> DataFrame:
    """Paper results from one call per paper: yes is Include, no is Exclude."""
    good = F.col("call_status") == "screened"
    blank = unprocessed_columns()
    return calls.select(
        *KEYS, F.col("call_status").alias("screening_status"), F.when(good, "llm_paper_decision").otherwise(F.col("call_reason")).alias("reason"),
        F.when(good, F.when(F.col("reply_decision") == "yes", "Include").otherwise("Exclude")).alias("decision"),
        blank["decision_confidence"].alias("decision_confidence"),
        F.when(good, "optional_check").otherwise("needs_processing").alias("review_group"),
        F.when(good, 3).otherwise(4).alias("group_rank"), F.lit(0).alias("blocking_count"), blank["score_gap"].alias("score_gap"),
        F.array().cast("array<struct<label:string>>").alias("criteria"))
