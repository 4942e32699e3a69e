"""Wide and long exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesieve.functions.text import guard_formula
from citesieve.operators.linkage import RECOVERY_COLUMNS
from citesieve.operators.screening import KEYS


def guard_formulas(df: DataFrame) -> DataFrame:
    """Apply the spreadsheet guard to every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: guard_formula(F.col(f"`{c}`")) for c in texts})


def recovery_table(recovery: DataFrame) -> DataFrame:
    """The fixed columns of the recovery list as guarded text."""
    return guard_formulas(recovery.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RECOVERY_COLUMNS]))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with a header; quotes inside values are doubled as in RFC 4180."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
     .option("nullValue", "").csv(path))


def write_recovery(recovery: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(recovery_table(recovery), path, mode)


def extra_keys(papers: DataFrame) -> list[str]:
    """Names found in the ``extra`` maps, in name order: the header of the export, which is one column per name."""
    return sorted(row.k for row in papers.select(F.explode(F.map_keys("extra")).alias("k")).distinct().collect())


# Exported names of a criterion's columns, in order, with the field each shows.
CRITERION_EXPORT = [
    ("decision", "criterion_decision"), ("human decision", "human_decision"), ("threshold", "confidence_threshold"),
    ("confidence", "confidence"), ("entailment", "entailment"), ("contradiction", "contradiction"), ("neutral", "neutral"),
    ("finding", "finding"), ("explicit evidence required", "explicit_evidence_required"), ("reason", "reason"),
    ("quote", "quote"), ("model confidence", "model_confidence"),
]
RESULT_EXPORT = [
    "screening_status", "decision", "reason", "decision_confidence", "review_group", "blocking_criteria", "score_gap",
    "human_decision", "input_issues", "llm_reason", "llm_quote", "llm_model_confidence", "panel_status", "final_decision",
    "second_reviewer", "judge",
]


def _labelled(label: str):
    return lambda c: c["label"] == label


def screening_wide(results: DataFrame, criteria: list[dict], extras: list[str] | None = None) -> DataFrame:
    """One row per paper: base, extra, result and twelve columns per criterion, all as guarded text.

    Criteria sit in the paper's own array, so the wide form is a projection and needs no pivot or shuffle.
    """
    have = results.columns
    if extras is None:
        extras = extra_keys(results) if "extra" in have else []

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def column(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    def rounded(c: Column) -> Column:
        return text(F.round(c, 4))

    consensus = "consensus" in have
    shown = {
        "decision_confidence": rounded(column("decision_confidence").cast("double")),
        "blocking_criteria": text(column("blocking_count")),
        "input_issues": F.coalesce(F.to_json("input_issues"), F.lit("[]")) if "input_issues" in have else F.lit("[]"),
        "llm_model_confidence": text(column("llm_confidence")),
        "panel_status": text(F.col("consensus.status") if consensus else F.lit(None)),
        "final_decision": text(F.col("consensus.decision") if consensus else F.lit(None)),
        "second_reviewer": F.coalesce(F.to_json("consensus.second_reviewer"), F.lit("null")) if consensus else F.lit("null"),
        "judge": F.coalesce(F.to_json("consensus.judge"), F.lit("null")) if consensus else F.lit("null"),
    }
    columns = [F.col("row")] + [text(F.col(c)).alias(c) for c in ["title", "abstract"]]
    columns += [text(F.element_at("extra", F.lit(k))).alias(k) for k in extras]
    columns += [shown.get(name, text(column(name))).alias(name) for name in RESULT_EXPORT]
    fields = results.schema["criteria"].dataType.elementType.fieldNames()
    numbers = {"confidence_threshold", "confidence", "entailment", "contradiction", "neutral"}
    for c in criteria:
        found = F.filter("criteria", _labelled(c["label"]))
        mine = F.get(found, F.size(found) - 1)
        for name, field in CRITERION_EXPORT:
            value = mine[field] if field in fields else F.lit(None)
            columns.append((rounded(value) if field in numbers and field in fields else text(value)).alias(f"{c['label']} ({name})"))
    return guard_formulas(results.select(*[c for c in KEYS if c not in ("row",)], *columns))


def write_screening_wide(results: DataFrame, criteria: list[dict], path: str, mode: str = "errorifexists") -> None:
    write_csv(screening_wide(results, criteria).drop("batch_id"), path, mode)


def extraction_wide(long: DataFrame, labels: list[str]) -> DataFrame:
    """One row per paper with value, status, confidence and joined quotes of every field (no formula guard)."""
    cell = F.first(F.struct(
        F.coalesce("value", F.lit("")).alias("value"), F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("confidence", F.lit("")).alias("confidence"), F.array_join("quotes", " | ").alias("evidence")))
    wide = long.groupBy(F.col("doc_id").alias("paper")).pivot("label", labels).agg(cell)
    columns = [F.col("paper")]
    for label in labels:
        columns += [F.col(f"`{label}`")["value"].alias(label)] + [
            F.col(f"`{label}`")[part].alias(f"{label} {part}") for part in ["status", "confidence", "evidence"]]
    return wide.select(*columns)


def write_extraction_wide(long: DataFrame, labels: list[str], path: str, mode: str = "errorifexists") -> None:
    write_csv(extraction_wide(long, labels), path, mode)


def write_table(df: DataFrame, path: str, partition: str | None = "batch_id", buckets: int | None = None,
                key: str = "doc_id", mode: str = "overwrite") -> None:
    """Persist a stage. Partitions present in ``df`` replace those on disk; others are untouched.

    With ``buckets`` the table is partitioned by a hash bucket of ``key``, so a later stage can
    prune to the documents it needs.
    """
    if buckets:
        partition = f"{key}_bucket"
        df = df.withColumn(partition, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
