"""Citation files: CSV and RIS, read as distributed lines and numbered as in the file.

A line's place is its block offset in the file and its order inside the block, so files are read
in parallel blocks; running counts carry one number per block.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesieve.functions.ordered import last_before, prefix_sum
from citesieve.functions.text import clean_text, normalize_doi

# Fixed values.
TEMPLATE = ["title", "abstract", "authors", "year", "doi", "journal", "url", "source_id"]
MAX_RECORDS = 50_000
RIS_LINE = r"^([A-Z0-9]{2})  -(?: ?)(.*)$"
RIS_TITLE, RIS_ABSTRACT = ["TI", "T1", "CT"], ["AB", "N2"]
RIS_YEAR, RIS_JOURNAL, RIS_SOURCE = ["PY", "Y1", "DA"], ["JF", "JO", "T2", "JA"], ["ID", "AN"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, line) of text files, the byte-order mark removed."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", "\\A\ufeff", ""))


# Fixed value, the quoting rule: a field is quoted if its first character is a quote; elsewhere a quote is data.
# After the closing quote all up to the next comma belongs to the field.
QUOTED = '"[^"]*+(?:""[^"]*+)*+"[^,]*+'
UNCLOSED = '"[^"]*+(?:""[^"]*+)*+$'
FIELDS = f'(?s)(?:(?:{QUOTED}|[^",][^,]*+)?,)*+'


def csv_values(record: Column) -> Column:
    """Values of one CSV record: a pair of quotes inside a quoted value is one quote."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f"(?s),((?:{QUOTED})|[^,]*+)"), F.lit(1))
    whole = f"(?s)^{QUOTED}$"
    inner = lambda x: F.replace(F.regexp_extract(x, '(?s)^"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"'))
    rest = lambda x: F.regexp_extract(x, '(?s)^"[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
    return F.transform(fields, lambda x: F.when(F.rlike(x, F.lit(whole)), F.concat(inner(x), rest(x))).otherwise(x))


def csv_malformed(record: Column) -> Column:
    """An unclosed quote, or text after the closing quote of a value."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f"(?s),((?:{QUOTED})|[^,]*+)"), F.lit(1))
    return F.exists(fields, lambda x: F.startswith(x, F.lit('"')) & ~F.rlike(x, F.lit('(?s)^"[^"]*+(?:""[^"]*+)*+"$')))


def csv_line_states(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_inside``: whether each line begins inside a quoted value.

    A line maps the state before it to the state after it. Lines that end in one state whatever came
    before fix it; the others keep it or turn it over. The state of a line is that of the last
    fixing line, turned as often as lines since then turn it; one number per block is carried.
    """
    after_close = f'(?s)^[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{FIELDS.removeprefix("(?s)")}{UNCLOSED})'
    from_outside = F.rlike("line", F.lit(f"(?s)^{FIELDS.removeprefix('(?s)')}{UNCLOSED}"))
    from_inside = F.rlike("line", F.lit('(?s)^[^"]*+(?:""[^"]*+)*+$')) | F.rlike("line", F.lit(after_close))
    marked = lines.withColumns({"_out": from_outside.cast("int"), "_in": from_inside.cast("int")})
    turns = F.when((F.col("_out") == 1) & (F.col("_in") == 0), 1).otherwise(0)
    marked = prefix_sum(marked, ["file"], ["place"], "block", turns, "_turns", inclusive=False)
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("state"), F.col("_turns").alias("turns")))
    marked = last_before(marked, ["file"], ["place"], F.col("block"), fixed, "_fixed")
    state = F.when(F.col("_fixed").isNull(), F.col("_turns")).otherwise(F.col("_fixed.state") + F.col("_turns") - F.col("_fixed.turns"))
    return marked.withColumn("_inside", state % 2 == 1)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, values, malformed): record 0 is the header; blank lines count.

    A file that ends inside a quoted value is refused: its last record has no end, and no part of it can be trusted.
    """
    marked = csv_line_states(read_lines(spark, path))
    open_ = F.max_by(F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out")), "place")
    cut = marked.groupBy("file").agg(open_.alias("open")).where("open = 1").limit(1).collect()
    if cut:
        raise ValueError(f"{cut[0]['file']} ends inside a quoted value")
    numbered = prefix_sum(marked, ["file"], ["place"], "block", F.when(F.col("_inside"), 0).otherwise(1), "_record")
    records = numbered.groupBy("file", (F.col("_record") - 1).alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return records.select("file", "record", text.alias("_t")).select(
        "file", "record", F.transform(csv_values(F.col("_t")), clean_text).alias("values"), csv_malformed(F.col("_t")).alias("malformed"))


def one_header(records: DataFrame) -> list[str]:
    """The header that all files share; files that differ are refused."""
    found = records.filter("record = 0").select("values").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("The files have different headers; read them one by one")
    return list(found[0]["values"]) if found else []


def batch_of(df: DataFrame, batch_id: str) -> Column:
    """The batch of a row: ``batch_id``, with the file's path from the common folder on where several files are read, so that rows stay unique."""
    low, high = df.agg(F.min("file"), F.max("file")).first()
    if low == high:
        return F.lit(batch_id)
    # the files in between share what the first and the last of them share
    folder = os.path.commonprefix([low, high]).rpartition("/")[0]
    return F.concat(F.lit(f"{batch_id}/"), F.substring("file", len(folder) + 2 if folder else 1, max(len(low), 1 << 20)))


def check_header(columns: list[str], required: list[str] = ["title", "abstract"]) -> None:
    """Names must be unique ignoring case and hold the required ones."""
    named = [c.strip().casefold() for c in columns if c.strip()]
    if len(named) != len(set(named)):
        raise ValueError("Two columns have the same name when case is ignored")
    missing = [c for c in required if c not in named]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")


def check_rows(records: DataFrame, header: list[str]) -> DataFrame:
    """Records with a value past the header or in an unnamed column, named by row number."""
    unnamed = [i for i, c in enumerate(header) if not c]
    beyond = F.size(F.filter("values", lambda x, i: (i >= len(header)) & (x != ""))) > 0
    hidden = F.lit(False)
    for i in unnamed:
        hidden = hidden | (F.coalesce(F.get("values", F.lit(i)), F.lit("")) != "")
    reason = (F.when(F.col("malformed"), "malformed_csv").when(beyond, "more_values_than_header")
              .when(hidden, "value_in_unnamed_column"))
    return records.withColumn("reject_reason", reason)


def enforce_record_limit(df: DataFrame, n: int = MAX_RECORDS) -> DataFrame:
    """Refuse more than ``n`` rows. Off by default elsewhere: it is an upload rule, not an engine limit."""
    if len(df.limit(n + 1).select(F.lit(1)).head(n + 1)) > n:
        raise ValueError(f"More than {n} rows")
    return df


def drop_blank_records(df: DataFrame) -> DataFrame:
    """Drop rows that have neither title nor abstract."""
    return df.filter((clean_text("title") != "") | (clean_text("abstract") != ""))


def with_extra_map(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Collect every named column but title and abstract into ``extra`` under its own name."""
    names = [c for c in (columns or df.columns) if c.strip() and c.strip().casefold() not in ("title", "abstract")]
    keys, values = F.array(*[F.lit(c) for c in names]), F.array(*[clean_text(F.col(f"`{c}`")) for c in names])
    return df.withColumn("extra", F.map_from_arrays(keys, values).cast("map<string,string>"))


def read_citations_csv(spark: SparkSession, path: str, batch_id: str, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Citation records and rejected rows of a CSV export.

    All files of ``path`` must have the same header. Rows are numbered per file; with several files
    the batch of a row carries its file's name.
    """
    records = read_csv_records(spark, path)
    header = one_header(records)
    check_header(header)
    batch = batch_of(records, batch_id)
    checked = check_rows(records.filter("record > 0"), header)
    lower = [c.casefold() for c in header]

    def value(i: int) -> Column:
        return F.coalesce(F.get("values", F.lit(i)), F.lit(""))

    columns = [(value(lower.index(c)) if c in lower else F.lit("")).alias(c) for c in TEMPLATE]
    extra = [(c, i) for i, c in enumerate(header) if c and lower[i] not in ("title", "abstract")]
    extra_map = (F.map_from_arrays(F.array(*[F.lit(c) for c, _ in extra]), F.array(*[value(i) for _, i in extra]))
                 if extra else F.create_map().cast("map<string,string>"))
    good = checked.filter("reject_reason IS NULL").select(
        batch.alias("batch_id"), F.col("record").alias("row"), *columns, extra_map.alias("extra"))
    good = drop_blank_records(good).withColumn("doi", normalize_doi("doi"))
    if max_records is not None:
        enforce_record_limit(records.filter("record > 0"), max_records)
    rejects = checked.filter("reject_reason IS NOT NULL").select(
        batch.alias("batch_id"), F.col("record").alias("row"), "reject_reason")
    return good, rejects


# --- RIS -------------------------------------------------------------------------------------

def read_citations_ris(spark: SparkSession, path: str, batch_id: str, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Citation records and rejected ones of RIS files.

    A record runs from its TY line to its ER line; a line without a tag continues the value above it.
    """
    order = ["place"]
    lines = read_lines(spark, path)
    lines = prefix_sum(lines, ["file"], order, "block", F.lit(1), "line_number").filter(clean_text("line") != "")
    tag = F.regexp_extract("line", RIS_LINE, 1)
    lines = lines.withColumns({"tag": tag, "text": F.when(tag != "", F.regexp_extract("line", RIS_LINE, 2)).otherwise(F.col("line"))})
    lines = prefix_sum(lines, ["file"], order, "block", F.when(F.col("tag") != "", 1).otherwise(0), "tag_ix")
    lines = prefix_sum(lines, ["file"], order, "block", F.when(F.col("tag") == "TY", 1).otherwise(0), "record")
    batch = batch_of(lines, batch_id)
    # lines before the first TY are no record; only the first of them is reported
    strays = lines.filter("record = 0").groupBy("file").agg(F.min("line_number").alias("line_number"))
    # each tagged line gathers its own continuations before a record gathers its tags, so no line is read twice
    texts = F.array_sort(F.collect_list(F.struct("line_number", clean_text("text").alias("text"))))
    values = lines.filter("record > 0").groupBy("file", "record", "tag_ix").agg(
        F.min_by("tag", "line_number").alias("tag"), F.min("line_number").alias("line"), texts.alias("_t"))
    values = values.select("file", "record", "line", "tag", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("value"))
    records = values.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line", "tag", "value"))).alias("_items"))
    records = records.withColumn("_end", F.array_position(F.transform("_items", lambda x: x["tag"]), "ER"))
    after = F.get("_items", F.col("_end").cast("int"))
    error = (F.when(F.col("_end") == 0, F.struct(F.lit("record_without_er").alias("reason"), F.get("_items", F.lit(0))["line"].alias("line")))
             .when(after.isNotNull(), F.struct(F.lit("record_must_start_with_ty").alias("reason"), after["line"].alias("line")))
             .when(F.contains(F.element_at("_items", F.col("_end").cast("int"))["value"], F.lit("\n")),
                   F.struct(F.lit("record_must_start_with_ty").alias("reason"), (F.element_at("_items", F.col("_end").cast("int"))["line"] + 1).alias("line"))))
    records = records.withColumn("_error", error).withColumn("_body", F.filter("_items", lambda x: x["tag"] != "ER"))
    fields = ris_to_record(records)
    blank = (F.col("title") == "") & (F.col("abstract") == "")
    fields = fields.withColumn("_error", F.coalesce("_error", F.when(blank, F.struct(
        F.lit("neither_title_nor_abstract").alias("reason"), F.get("_items", F.lit(0))["line"].alias("line")))))
    good = fields.filter("_error IS NULL").select(batch.alias("batch_id"), F.col("record").alias("row"), *TEMPLATE, "extra")
    if max_records is not None:
        enforce_record_limit(good, max_records)
    rejects = fields.filter("_error IS NOT NULL").select(
        batch.alias("batch_id"), F.col("record").alias("row"), F.col("_error.reason").alias("reject_reason"),
        F.col("_error.line").alias("line_number")).unionByName(strays.select(
            batch.alias("batch_id"), F.lit(0).cast("long").alias("row"), F.lit("record_must_start_with_ty").alias("reject_reason"), "line_number"))
    return good, rejects


def ris_to_record(records: DataFrame) -> DataFrame:
    """Record fields from ``_body`` (tag, line, value): the first non-blank value of the preferred tags."""
    def values(tag: str) -> Column:
        return F.transform(F.filter("_body", lambda x: x["tag"] == tag), lambda x: x["value"])

    def first(tags: list[str]) -> Column:
        found = F.filter(F.concat(*[values(t) for t in tags]), lambda v: clean_text(v) != "")
        return F.coalesce(F.get(found, F.lit(0)), F.lit(""))

    authors = F.when(F.size(values("AU")) > 0, values("AU")).otherwise(values("A1"))
    names = F.array_distinct(F.transform("_body", lambda x: x["tag"]))
    extra = F.map_from_arrays(names, F.transform(names, lambda t: F.array_join(
        F.transform(F.filter("_body", lambda x: x["tag"] == t), lambda x: x["value"]), "\n")))
    columns = {
        "title": first(RIS_TITLE), "abstract": first(RIS_ABSTRACT), "authors": F.array_join(authors, "; "),
        "year": F.substring_index(first(RIS_YEAR), "/", 1), "doi": normalize_doi(first(["DO"])), "journal": first(RIS_JOURNAL),
        "url": first(["UR"]), "source_id": first(RIS_SOURCE)}
    return records.withColumns({**{k: clean_text(v) for k, v in columns.items()}, "extra": extra})


# --- reference-manager lists -----------------------------------------------------------------

LIBRARY = ["title", "authors", "year", "doi", "pdf_path"]


def read_library_csv(spark: SparkSession, path: str, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Library rows (library_row, title, authors, year, doi, pdf_path) and rejected rows."""
    records = read_csv_records(spark, path)
    header = [c.casefold() for c in one_header(records)]
    if len(set(header)) != len(header):
        raise ValueError("Two columns have the same name")
    if "pdf_path" not in header or not {"title", "doi"} & set(header):
        raise ValueError("Missing columns: pdf_path, and title or doi")
    if max_records is not None:
        enforce_record_limit(records.filter("record > 0"), max_records)
    rows = records.filter("record > 0").filter(F.exists("values", lambda x: x != ""))
    columns = [(F.coalesce(F.get("values", F.lit(header.index(c))), F.lit("")) if c in header else F.lit("")).alias(c) for c in LIBRARY]
    shown = check_rows(rows, header).select(F.col("record").alias("library_row"), *columns, "reject_reason")
    needs = (F.col("pdf_path") == "") | ((F.col("title") == "") & (F.col("doi") == ""))
    shown = shown.withColumn("reject_reason", F.coalesce("reject_reason", F.when(needs, "needs_pdf_path_and_title_or_doi")))
    return (shown.filter("reject_reason IS NULL").drop("reject_reason"),
            shown.filter("reject_reason IS NOT NULL").select("library_row", "reject_reason"))


