"""Full-text handoff and linkage of reference-manager lists to screened papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.functions.text import clean_text, doi_key, fold, normalize_doi, normalized_title
from citesieve.operators.screening import DECISIONS, KEYS

# Fixed values.
METADATA = ["title", "authors", "year", "doi", "journal", "url", "source_id"]
RECOVERY_COLUMNS = ["record_id", *METADATA, "decision", "decision_source", "recovery_reason", "pdf_filename", "file_status"]


def metadata_from_extra(df: DataFrame) -> DataFrame:
    """Blank metadata filled from the ``extra`` map, whose keys are compared case-folded; DOI prefixes dropped."""
    have = df.columns
    if "extra" in have:
        entries = F.transform(F.map_entries("extra"), lambda e: F.struct(fold(e["key"]).alias("key"), e["value"].alias("value")))
        df = df.withColumn("_extra", entries)

    def value(name: str) -> Column:
        own = F.nullif(F.col(name), F.lit("")) if name in have else F.lit(None).cast("string")
        if "extra" not in have:
            return clean_text(own)
        matches = F.filter("_extra", lambda e: e["key"] == name)
        return clean_text(F.coalesce(own, F.get(matches, F.size(matches) - 1)["value"]))

    df = df.withColumns({name: value(name) for name in METADATA})
    return df.withColumn("doi", normalize_doi("doi")).drop("_extra")


def recovery_list(results: DataFrame) -> DataFrame:
    """Papers that go on to full text: effective decision (consensus, then human, then machine), its source and why.

    ``consensus_status`` marks a panel paper; without that column no paper is one.
    """
    missing = F.col("screening_status") == "missing_abstract"
    human = F.col("human_decision") if "human_decision" in results.columns else F.lit(None).cast("string")
    is_human = F.coalesce(human.isin(*DECISIONS), F.lit(False))
    panel = F.col("consensus_status").isNotNull() if "consensus_status" in results.columns else F.lit(False)
    agreed = F.col("consensus_decision") if "consensus_decision" in results.columns else F.lit(None).cast("string")
    effective = F.when(panel, agreed).when(is_human, human).otherwise(F.col("decision"))
    df = results.withColumns({
        "_effective": effective,
        "decision_source": F.when(panel, "panel").when(is_human, "human").otherwise("screening"),
        "_panel": panel, "_missing": missing})
    settled = F.coalesce(F.col("_effective").isin("Include", "Exclude"), F.lit(False))
    wanted = F.coalesce(F.col("_effective").isin("Include", "Likely include", "Maybe"), F.lit(False))
    df = df.filter((~F.col("_panel") | settled | F.col("_missing")) & ~F.col("_effective").eqNullSafe("Exclude")
                   & (wanted | F.col("_missing")))
    df = df.withColumn("recovery_reason", F.when(F.col("_effective") == "Include", "advance_to_full_text")
                       .when(F.col("_effective") == "Likely include", "confirm_inclusion_gaps")
                       .when(F.col("_missing"), "resolve_missing_abstract").otherwise("resolve_uncertainty"))
    record = F.concat(F.lit("sr-"), "batch_id", F.lit("-r"), "row")
    df = metadata_from_extra(df.withColumn("decision", F.col("_effective")))
    return df.select(*KEYS, record.alias("record_id"), *METADATA, "decision", "decision_source", "recovery_reason",
                     F.concat(record, F.lit(".pdf")).alias("pdf_filename"))


def duplicate_rows(results: DataFrame) -> DataFrame:
    """Rows that break the handoff: a row number below 1 or used twice in its batch."""
    return results.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > 1) | ~F.coalesce(F.col("row") >= 1, F.lit(False)))


def file_status(recovery: DataFrame, inventory: DataFrame) -> DataFrame:
    """present, invalid_signature, unreadable or missing, from the file inventory."""
    files = inventory.select(F.col("filename").alias("pdf_filename"), F.col("file_error").alias("_error"),
                             F.lit(True).alias("_found")).dropDuplicates(["pdf_filename"])
    return recovery.join(files, "pdf_filename", "left").withColumn(
        "file_status", F.when(F.col("_found").isNull(), "missing").when(F.col("_error") == "invalid_signature", "invalid_signature")
        .when(F.col("_error") == "unreadable", "unreadable").otherwise("present")).drop("_found", "_error")


# --- matching --------------------------------------------------------------------------------

def match_keys(df: DataFrame, exact_titles: bool = True) -> DataFrame:
    return df.withColumns({"doi_key": doi_key("doi"), "title_key": normalized_title("title", exact_titles)})


def paper_index(papers: DataFrame, exact_titles: bool = True) -> DataFrame:
    """One row per (method, key): how many papers carry it, and the paper itself when it is the only one.

    A key shared by very many papers stays one small row: counting combines before the shuffle
    and no list of the papers is built.
    """
    keyed = match_keys(papers, exact_titles)
    entry = F.struct("row", "title", "doi", "doi_key", "title_key")
    keys = F.array(F.struct(F.lit("doi").alias("method"), F.col("doi_key").alias("key")),
                   F.struct(F.lit("title").alias("method"), F.col("title_key").alias("key")))
    rows = keyed.select(entry.alias("paper"), F.explode(keys).alias("k")).filter("k.key <> ''")
    return rows.groupBy(F.col("k.method").alias("match_method"), F.col("k.key").alias("match_key")).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min_by("paper", "paper.row").alias("candidate"))


def match_library(library: DataFrame, papers: DataFrame, exact_titles: bool = True) -> DataFrame:
    """Match each library row by DOI, or by title where the DOI found nothing.

    The paper side of both joins is unique per key, so no join multiplies rows. Library rows that
    share a hot title are a skewed but row-preserving left join, which adaptive execution splits.
    Candidates of an ambiguous row are those of its ``match_key`` in :func:`match_candidates`.
    """
    index = paper_index(papers, exact_titles)
    keyed = match_keys(library, exact_titles)

    def side(method: str) -> DataFrame:
        return index.filter(F.col("match_method") == method).select(
            F.col("match_key").alias(f"_{method}"), F.struct("n_candidates", "candidate").alias(f"_{method}_hit"))

    # Rows without a key, and titles of rows whose DOI was found, look up a key no paper has; it is
    # spread over many values so that they do not meet in one task.
    nothing = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("library_row"), F.lit(4096)))
    joined = keyed.withColumn("_doi", F.when(F.col("doi_key") != "", F.col("doi_key")).otherwise(nothing)).join(
        side("doi"), "_doi", "left")
    by_title = F.col("_doi_hit").isNull() & (F.col("title_key") != "")
    joined = joined.withColumn("_title", F.when(by_title, F.col("title_key")).otherwise(nothing)).join(
        side("title"), "_title", "left")
    hit = F.coalesce("_doi_hit", "_title_hit")
    method = F.when(F.col("_doi_hit").isNotNull(), "doi").when(F.col("_title_hit").isNotNull(), "title")
    joined = joined.withColumns({
        "match_method": method, "n_candidates": F.coalesce(hit["n_candidates"], F.lit(0)),
        "match_key": F.when(method == "doi", F.col("doi_key")).when(method == "title", F.col("title_key")),
        "candidate": F.when(hit["n_candidates"] == 1, hit["candidate"])})
    return joined.withColumn("match_status", match_status()).drop("_doi", "_title", "_doi_hit", "_title_hit")


def match_status() -> Column:
    """unmatched, ambiguous, metadata_conflict or proposed."""
    other = F.col("candidate")
    differ = (F.col("doi_key") != "") & (other["doi_key"] != "") & (F.col("doi_key") != other["doi_key"])
    titles = ((F.col("match_method") == "doi") & (F.col("title_key") != "") & (F.coalesce(other["title"], F.lit("")) != "")
              & (F.col("title_key") != other["title_key"]))
    return (F.when(F.col("n_candidates") == 0, "unmatched").when(F.col("n_candidates") > 1, "ambiguous")
            .when(differ | titles, "metadata_conflict").otherwise("proposed"))


def match_candidates(matches: DataFrame, papers: DataFrame, exact_titles: bool = True) -> DataFrame:
    """All candidates of the ambiguous library rows, listed once per match key.

    Library rows and papers of one key are related through the key; their pairs are never written out,
    since a title shared by many on both sides would square.
    """
    wanted = matches.filter("match_status = 'ambiguous'").select("match_method", "match_key").distinct()
    keyed = match_keys(papers, exact_titles)
    keys = F.array(F.struct(F.lit("doi").alias("method"), F.col("doi_key").alias("key")),
                   F.struct(F.lit("title").alias("method"), F.col("title_key").alias("key")))
    rows = keyed.select("row", "title", "doi", F.explode(keys).alias("_k")).select(
        F.col("_k.method").alias("match_method"), F.col("_k.key").alias("match_key"), "row", "title", "doi")
    return rows.join(wanted, ["match_method", "match_key"], "left_semi")


def import_preview(library: DataFrame, papers: DataFrame, inventory: DataFrame, exact_titles: bool = True) -> DataFrame:
    """Library rows with their match and the hash, or the fault, of their file."""
    matched = match_library(library, papers, exact_titles)
    files = inventory.select(F.col("filename").alias("pdf_path"), "sha256", F.col("file_error").alias("_error"),
                             F.lit(True).alias("_found")).dropDuplicates(["pdf_path"])
    joined = matched.join(files, "pdf_path", "left")
    return joined.withColumn("file_error", F.coalesce("_error", F.when(F.col("_found").isNull(), "not_found"))).drop("_error", "_found")


def confirm_links(requests: DataFrame, preview: DataFrame, inventory: DataFrame, targets: DataFrame,
                  attached: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted links and refused requests.

    ``requests`` has (library_row, batch_id, row, ts, event_id). Both sides must exist, the file must still have
    the hash of the preview, and no other file may be attached to the paper.
    """
    records = preview.select("library_row", "pdf_path", F.col("sha256").alias("_seen"), F.col("match_method").alias("_method"),
                             F.col("match_status").alias("_status"), F.col("candidate.row").alias("_proposed"), F.lit(True).alias("_record"))
    chosen = targets.select(*KEYS, "record_id", "pdf_filename", F.lit(True).alias("_target"))
    now = inventory.select(F.col("filename").alias("pdf_path"), F.col("sha256").alias("_now"), F.col("file_error").alias("_error"))
    df = requests.join(records, "library_row", "left").join(chosen, KEYS, "left").join(now, "pdf_path", "left")
    other = F.lit(None).cast("string")
    if attached is not None:
        df = df.join(attached.select(F.col("filename").alias("pdf_filename"), F.col("sha256").alias("_attached")), "pdf_filename", "left")
        other = F.col("_attached")
    reject = (F.when(F.col("_record").isNull() | F.col("_target").isNull(), "unknown_record_or_target")
              .when(F.col("_now").isNull() | F.col("_error").isNotNull(), "file_unusable")
              .when(~F.col("_now").eqNullSafe(F.col("_seen")), "file_changed")
              .when(other.isNotNull() & (other != F.col("_now")), "other_file_attached"))
    proposed = (F.col("_status") == "proposed") & F.col("_proposed").eqNullSafe(F.col("row"))
    df = df.withColumns({"reject_reason": reject, "match_method": F.when(proposed, F.col("_method")).otherwise("manual"),
                         "sha256": F.col("_now")})
    links = df.filter("reject_reason IS NULL").select(
        *KEYS, "record_id", "library_row", "pdf_filename", F.col("pdf_path").alias("original_path"), "sha256", "match_method",
        "ts", "event_id")
    return links, df.filter("reject_reason IS NOT NULL").select(*requests.columns, "reject_reason")


def latest_links(links: DataFrame) -> DataFrame:
    """One link per screening row; the last one wins."""
    fields = [c for c in links.columns if c not in KEYS]
    last = F.max_by(F.struct(*fields), F.struct("ts", "event_id"))
    return links.groupBy(*KEYS).agg(last.alias("_l")).select(*KEYS, "_l.*")
