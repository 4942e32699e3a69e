"""Quality rules whose cutoffs are risk-controlled on labelled documents, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesieve.llm.common import BLANKS, UPPER, stage, words
from citesieve.session import compute_once

SYMBOLS = "#*$%&|<>"
#: Rule: (numerator, denominator); its score is the numerator per thousand of the denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs per thousand, tried from the most lenient (last) to the strictest.
CUTOFFS = (20, 50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)
#: Share of good documents that the rules together may reject in a stratum, and the chance that any stratum exceeds it.
RISK, ERROR = 0.02, 0.05
MIN_WORDS, MAX_REPEAT = 10, 20
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def document_metrics(documents: DataFrame, carry: list[str], stratum: str = "lang", window: int = 5) -> DataFrame:
    """Struct ``row`` of the columns ``carry``, ``stratum`` and the counts of every whole text (null: no words).

    ``n_repeat_words`` counts the words inside ``window``-word windows that occur twice or more in the
    text. Windows are compared by 64-bit hashes inside one document; they are sorted only when the
    document has two equal ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(F.struct(*carry).alias("row"), F.col(stratum).cast("string").alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    base = base.select("row", "stratum", words(F.col("text")).alias("w"), F.translate("text", BLANKS, "").alias("chars"), lines.alias("lines"))
    counted = base.select(
        "row", "stratum", F.size("w").cast("long").alias("n_words"), F.length("chars").cast("long").alias("word_chars"),
        (F.length("chars") - F.length(F.translate("chars", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("chars") - F.length(F.translate("chars", UPPER, ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    every = F.when(F.size("h") >= window, F.transform(
        F.sequence(F.lit(0), F.size("h") - window), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(window)])))
    hashed = counted.withColumn("h", every)
    twice = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    sorted_ = hashed.withColumn("h", placed)

    def equal(x: Column, at: Column) -> Column:
        return F.coalesce(x["h"] == F.get("h", at)["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("h", lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["i"]))
    started = sorted_.withColumn("h", starts)
    covered = F.aggregate(F.transform("h", lambda p, i: F.least(F.lit(window), F.get("h", i + 1) - p).cast("long")),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    return started.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select("row", "stratum", *METRICS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def exceeded(rule: str, cutoffs=CUTOFFS) -> Column:
    """How many cutoffs the score of a rule lies above."""
    top, below = (F.col(c) for c in RULES[rule])
    return sum((F.when(1000 * top > c * below, 1).otherwise(0) for c in cutoffs), F.lit(0))


def ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, carried up by eight so that it is good to eleven digits from 0 on."""
    z = n + F.lit(9.0)
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for k in range(1, 9):
        series = series - F.ln(n + float(k))
    return series


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed from exact terms.

    Left out are only terms that add nothing to a double: those more than 40 square roots of n below
    both k and the mean, and those as far above the mean (exp(-3200) in all, by Hoeffding's bound).
    """
    mean, reach = F.floor(n * p).cast("long"), F.ceil(40 * F.sqrt(n)).cast("long") + 40
    low, high = F.greatest(F.lit(0), F.least(k, mean) - reach), F.least(k, mean + reach)

    def term(i: Column) -> Column:
        return F.exp(ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) + i * math.log(p) + (n - i) * math.log1p(-p))

    return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda a, i: a + term(i))


def select_cutoffs(metrics: DataFrame, labels: DataFrame, row_id: Column, cutoffs=CUTOFFS, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per stratum and rule the cutoff (place in ``cutoffs``, from 1) that labelled documents prove safe.

    The holdout is every labelled document that passes the base rules. A cutoff is safe when the
    exact binomial test rejects that its share of falsely rejected good documents reaches
    ``risk`` / rules: P(X <= k | n, risk / rules) <= ``error`` / (strata * rules). That splits the
    error over all strata and rules; the cutoffs of one rule are tested from the most lenient on and
    end at the first that fails, which needs no further correction. Among the safe ones the one
    that rejects most bad documents is taken, the most lenient of equals; none if none rejects any.
    A stratum without enough labels gets no cutoffs. Repeated labels of a document count once, as good if any is.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    scored = metrics.where(~base_failed()).select(row_id.alias("doc_id"), "stratum", *[exceeded(r, cutoffs).alias(r) for r in RULES])
    held = scored.join(marks, "doc_id").select(
        "stratum", (F.col("quality") > 0).alias("good"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("above")) for r in RULES])).alias("s")).select("stratum", "good", "s.*")
    counts = stage(held.groupBy("stratum", "rule", "above").agg(
        F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad")), "quality-holdout")
    strata = counts.select(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))).distinct().count()
    tests = max(1, strata) * len(RULES)
    grid = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("above", "good", "bad")).alias("seen"))
    grid = grid.select("stratum", "rule", "n", "seen", F.explode(F.sequence(F.lit(1), F.lit(len(cutoffs)))).alias("cutoff"))

    def rejected(name: str) -> Column:
        return F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + F.when(x["above"] >= F.col("cutoff"), x[name]).otherwise(0))

    share = risk / len(RULES)
    tested = grid.withColumn("k", rejected("good")).withColumn("hits", rejected("bad"))
    tested = tested.withColumn("fails", (binomial_cdf(F.col("k"), F.col("n"), share) > error / tests).cast("int"))
    lenient_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    safe = tested.withColumn("failed", F.sum("fails").over(lenient_first)).where("failed = 0 and hits > 0")
    return safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("hits", "cutoff")).alias("cutoff"))


def apply_cutoffs(metrics: DataFrame, chosen: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """``metrics`` with base_failed, rejected_by (the rules, comma-joined; empty if none) and kept.

    The cutoffs are one row per stratum, so they are as many as the strata; Spark broadcasts them by their measured size.
    """
    per = stage(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")), "quality-cutoffs")
    joined = metrics.alias("m").join(per.alias("c"), F.col("m.stratum").eqNullSafe(F.col("c.stratum")), "left").select("m.*", "cuts")
    hits = F.array(*[F.when(exceeded(r, cutoffs) >= F.col("cuts")[r], F.lit(r)) for r in RULES])
    joined = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_join(F.array_compact(hits), ","))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).drop("cuts")


def quality_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per row of ``documents``: doc_id, the counts, base_failed, rejected_by and kept.

    Null and blank texts have no words and fail the base rules. A null stratum is a stratum. Repeated
    rows are rows of their own. Without labels only the base rules decide; an empty table gives an
    empty result. No other columns are read.
    """
    metrics = stage(document_metrics(documents, ["doc_id"], stratum), "quality-metrics")
    chosen = select_cutoffs(metrics, labels, F.col("row.doc_id"))
    done = apply_cutoffs(metrics, chosen)
    return done.select(F.col("row.doc_id").alias("doc_id"), *METRICS, "base_failed", "rejected_by", "kept")


def keep_good(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps, with all their columns.

    The counts are staged for choosing the cutoffs and made again beside the texts, which are never shuffled.
    """
    metrics = stage(document_metrics(documents, ["doc_id"], stratum), "quality-metrics")
    chosen = select_cutoffs(metrics, labels, F.col("row.doc_id"))
    counted = compute_once(document_metrics(documents, documents.columns, stratum), {c: F.col(c) for c in METRICS})
    return apply_cutoffs(counted, chosen).where("kept").select("row.*")
