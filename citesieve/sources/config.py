"""Configuration documents (criteria, field tables) and the file inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.functions.text import fold
from citesieve.session import config_rows

CRITERIA_SCHEMA = ("schema_version STRING, criteria ARRAY<STRUCT<label: STRING, statement: STRING, type: STRING, "
                   "explicit_evidence_required: BOOLEAN, confidence_threshold: DOUBLE>>")
FIELDS_SCHEMA = ("schema_version STRING, groups ARRAY<STRUCT<label: STRING, fields: ARRAY<STRUCT<id: STRING, label: STRING, "
                 "description: STRING, rules: STRING, value_type: STRING, allowed_values: ARRAY<STRING>>>>>")

# Fixed values.
VALUE_TYPES = ["string", "integer", "number", "boolean", "array"]
DOCUMENT_SUFFIXES = ["pdf", "png", "jpg", "jpeg", "docx", "pptx", "xlsx"]
MAX_PDF_BYTES = 52_428_800


def read_criteria(spark: SparkSession, path: str, default_threshold: float = 0.8) -> DataFrame:
    """(ord, label, statement, type, explicit_evidence_required, confidence_threshold) in document order."""
    document = spark.read.schema(CRITERIA_SCHEMA).json(path, multiLine=True)
    rows = document.select(F.posexplode("criteria").alias("ord", "c")).select("ord", "c.*")
    return rows.withColumns({
        "explicit_evidence_required": F.coalesce("explicit_evidence_required", F.lit(False)),
        "confidence_threshold": F.coalesce("confidence_threshold", F.lit(default_threshold))})


def criteria_list(criteria: DataFrame) -> list[dict]:
    """The criteria as configuration of a screening run, checked and in order."""
    problems = check_criteria(criteria).collect()
    if problems:
        raise ValueError("; ".join(f"{r.label}: {r.reject_reason}" for r in problems))
    return sorted(config_rows(criteria), key=lambda c: c["ord"])


def check_criteria(criteria: DataFrame) -> DataFrame:
    """Blank or repeated labels, blank statements, unknown types, thresholds out of range, and no include criterion."""
    label = F.trim(F.coalesce("label", F.lit("")))
    rule = (F.when(label == "", "blank_label").when(F.trim(F.coalesce("statement", F.lit(""))) == "", "blank_statement")
            .when(~F.coalesce(F.col("type").isin("include", "exclude"), F.lit(False)), "unknown_type")
            .when(~F.col("confidence_threshold").between(0.5, 1.0), "threshold_outside_range"))
    single = criteria.select(label.alias("label"), rule.alias("reject_reason")).filter("reject_reason IS NOT NULL")
    repeated = criteria.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "label", F.lit("repeated_label").alias("reject_reason"))
    none = criteria.agg(F.count_if(F.col("type") == "include").alias("n")).filter("n = 0").select(
        F.lit("").alias("label"), F.lit("no_include_criterion").alias("reject_reason"))
    return single.unionByName(repeated).unionByName(none)


def read_field_table(spark: SparkSession, path: str) -> DataFrame:
    """Flattened fields with group and positions; an empty group is one row with a null id."""
    document = spark.read.schema(FIELDS_SCHEMA).json(path, multiLine=True)
    groups = document.select(F.posexplode("groups").alias("group_ord", "g"))
    fields = groups.select("group_ord", F.trim("g.label").alias("group"), F.posexplode_outer("g.fields").alias("field_ord", "f"))
    return fields.select("group_ord", "group", "field_ord", "f.*").withColumn("value_type", F.coalesce("value_type", F.lit("string")))


def check_field_table(fields: DataFrame) -> DataFrame:
    """Repeated ids, labels or group labels, empty groups, malformed ids, unknown value types, and an empty table."""
    def repeated(df: DataFrame, name: str, reason: str) -> DataFrame:
        return df.filter(F.col(name).isNotNull()).groupBy(F.trim(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter(
            "n > 1").select("name", F.lit(reason).alias("reject_reason"))

    groups = fields.select("group_ord", "group").distinct()
    rule = (F.when(F.col("id").isNull(), "empty_group").when(~F.col("id").rlike("^[a-z0-9][a-z0-9_-]*$"), "malformed_id")
            .when(~F.col("value_type").isin(*VALUE_TYPES), "unknown_value_type"))
    single = fields.select(F.coalesce("id", "group").alias("name"), rule.alias("reject_reason")).filter("reject_reason IS NOT NULL")
    none = fields.agg(F.count("id").alias("n")).filter("n = 0").select(F.lit("").alias("name"), F.lit("no_fields").alias("reject_reason"))
    return (single.unionByName(repeated(fields, "id", "repeated_id")).unionByName(repeated(fields, "label", "repeated_label"))
            .unionByName(repeated(groups, "group", "repeated_group")).unionByName(none))


def field_list(fields: DataFrame) -> list[dict]:
    problems = check_field_table(fields).collect()
    if problems:
        raise ValueError("; ".join(f"{r.name}: {r.reject_reason}" for r in problems))
    return sorted(config_rows(fields), key=lambda f: (f["group_ord"], f["field_ord"]))


def scan_pdf_inventory(spark: SparkSession, directory: str, max_bytes: int = MAX_PDF_BYTES) -> DataFrame:
    """(path, filename, stem, suffix, length, sha256, file_error) of a folder; oversized files are not hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    signed = F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")
    shown = ["path", name.alias("filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
             F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), "length"]
    # the size test reaches the source, so the content of an oversized file is never read
    fits = files.filter(F.col("length") <= max_bytes).select(
        *shown, F.when(signed, F.sha2("content", 256)).alias("sha256"), F.when(~signed, "invalid_signature").alias("file_error"))
    large = files.filter(F.col("length") > max_bytes).select(*shown, F.lit(None).cast("string").alias("sha256"), F.lit("exceeds_size_limit").alias("file_error"))
    return fits.union(large)


def check_documents(files: DataFrame, suffixes: list[str] = DOCUMENT_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Usable document files, and the refused ones: suffix not supported, listed twice, or stems equal ignoring case."""
    counted = files.groupBy("path").agg(F.count(F.lit(1)).alias("_times"), F.first("stem").alias("stem"), F.first("suffix").alias("suffix"))
    stems = counted.filter(F.col("suffix").isin(*suffixes)).groupBy(fold("stem").alias("_stem")).agg(F.count(F.lit(1)).alias("_stems"))
    judged = counted.withColumn("_stem", fold("stem")).join(stems, "_stem", "left")
    reason = (F.when(~F.col("suffix").isin(*suffixes), "unsupported_type").when(F.col("_times") > 1, "duplicate_file")
              .when(F.col("_stems") > 1, "stem_not_unique"))
    judged = judged.select("path", "stem", "suffix", reason.alias("reject_reason"))
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")
