"""Queries of the scalar text and vector expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesieve.functions import text as t
from citesieve.functions import vectors as v
from citesieve.operators import linkage
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry
from citesieve.sources import sinks

QUERIES, ORACLES, register = registry()


@register("clean_text", r"""
SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS cleaned FROM (SELECT doc_id, chr(10) || '  ' || text || chr(9) || chr(10) AS text FROM documents)""")
def clean(spark, sf):
    padded = F.concat(F.lit("\n  "), F.col("text"), F.lit("\t\n"))
    return fx.table(spark, sf, "documents").select("doc_id", t.clean_text(padded).alias("cleaned"))


@register("drop_blank_records", """
SELECT doc_id FROM documents WHERE doc_id % 20 <> 0 OR lang <> 'fr'""")
def blank(spark, sf):
    from citesieve.sources.citations import drop_blank_records

    papers = fx.papers(spark, sf).withColumn("title", F.when(F.col("lang") == "fr", F.lit(" \n")).otherwise(F.col("title")))
    return drop_blank_records(papers).select("doc_id")


@register("normalize_doi", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '10.5555/' || doc_id || ' DOI:x' ELSE '10.5555/' || doc_id END AS doi FROM documents""")
def doi(spark, sf):
    plain = F.concat(F.lit("10.5555/"), "doc_id")
    turn = F.col("doc_id") % 3
    given = (F.when(turn == 0, F.concat(F.lit("  https://dx.doi.org/"), plain)).when(turn == 1, F.concat(F.lit("DOI: "), plain))
             .otherwise(F.concat(plain, F.lit(" DOI:x "))))
    return fx.table(spark, sf, "documents").select("doc_id", t.normalize_doi(given).alias("doi"))


@register("normalized_title", r"""
SELECT doc_id, trim(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS title_key FROM documents""")
def title(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", t.normalized_title(F.substring_index("text", "\n", 1)).alias("title_key"))


@register("quote_in_text", r"""
WITH q AS (SELECT item_id, text FROM benchmark),
b AS (SELECT d.doc_id, d.text, q.text AS quote FROM documents d JOIN q ON q.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, contains(lower(regexp_replace(text, '\s+', ' ', 'g')), lower(regexp_replace(trim(quote), '\s+', ' ', 'g'))) AS found FROM b""")
def quote(spark, sf):
    items = fx.table(spark, sf, "benchmark").select("item_id", F.upper("text").alias("quote"))
    n = items.count()
    docs = fx.table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % n)
    return docs.join(items, "item_id").select("doc_id", t.quote_in_text("quote", "text").alias("found"))


@register("l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: 9 * y::DOUBLE * y::DOUBLE)))))), 6) AS total,
       1.0::DOUBLE AS norm FROM embeddings""")
def normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = fx.table(spark, sf, "embeddings").select("vec_id", v.l2_normalize(scaled).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                       F.round(F.sqrt(v.dot("u", "u")), 6).alias("norm"))


@register("premise", fx.sql(fx.SQL_PAPERS, select=r"""
SELECT doc_id, 'Title: ' || title || chr(10) || 'Abstract: ' || regexp_replace(abstract, '^\s+|\s+$', '', 'g') AS premise FROM papers WHERE abstract <> ''"""))
def premise(spark, sf):
    return fx.papers(spark, sf).filter("abstract <> ''").select("doc_id", t.premise("title", "abstract").alias("premise"))


@register("strip_references", r"""
SELECT doc_id, regexp_replace(text, '\s+$', '') AS body FROM documents""")
def references(spark, sf):
    full = F.concat("text", F.lit("\n\n## References  \n[1] A. Author\n# Appendix\n"), "text")
    return fx.table(spark, sf, "documents").select("doc_id", t.strip_references(full).alias("body"))


@register("is_ref_section", """
SELECT doc_id, section, regexp_matches(lower(section), 'reference|bibliography|works cited') AS is_ref
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Annex > REFERENCES' WHEN 1 THEN 'Works Cited ' || source ELSE source END AS section FROM documents)""")
def ref(spark, sf):
    turn = F.col("doc_id") % 4
    section = F.when(turn == 0, "Annex > REFERENCES").when(turn == 1, F.concat(F.lit("Works Cited "), "source")).otherwise(F.col("source"))
    return fx.table(spark, sf, "documents").select("doc_id", section.alias("section"), t.is_ref_section(section).alias("is_ref"))


@register("is_numeric_cell", """
SELECT l_orderkey, l_linenumber, l_comment_word, length(regexp_replace(l_comment_word, '[^a-zA-Z]', '', 'g')) < 2 AS numeric_cell
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT || ' ' || left(l_returnflag, 1) ELSE l_returnflag || l_linestatus END AS l_comment_word FROM lineitem)""")
def numeric(spark, sf):
    cell = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_quantity").cast("bigint"), F.lit(" "), F.substring("l_returnflag", 1, 1))).otherwise(F.concat("l_returnflag", "l_linestatus"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", cell.alias("l_comment_word"), t.is_numeric_cell(cell).alias("numeric_cell"))


@register("is_safe_pdf_path", """
SELECT doc_id, doc_id % 6 IN (0, 1) AS safe FROM documents""")
def path(spark, sf):
    forms = ["a/{}.pdf", "b\\{}.PDF", "../{}.pdf", "/x/{}.pdf", "C:\\{}.pdf", "a/{}.txt"]
    given = F.lit("")
    for i, form in enumerate(forms):
        before, after = form.split("{}")
        given = F.when(F.col("doc_id") % 6 == i, F.concat(F.lit(before), "doc_id", F.lit(after))).otherwise(given)
    return fx.table(spark, sf, "documents").select("doc_id", t.is_safe_pdf_path(given).alias("safe"))


@register("token_count", r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]'))::INT AS tokens FROM documents""")
def tokens(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", t.token_count("text").alias("tokens"))


@register("guard_formulas", r"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '''=' || title WHEN 1 THEN ''' +' || title WHEN 2 THEN '''@' || title
       ELSE title END AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)""")
def guard(spark, sf):
    head = F.substring_index("text", "\n", 1)
    turn = F.col("doc_id") % 5
    given = F.when(turn == 0, F.concat(F.lit("="), head)).when(turn == 1, F.concat(F.lit(" +"), head)).when(
        turn == 2, F.concat(F.lit("@"), head)).otherwise(head)
    return sinks.guard_formulas(fx.table(spark, sf, "documents").select("doc_id", given.alias("title")))


@register("metadata_from_extra", """
SELECT doc_id, lang AS journal, '10.5555/' || doc_id AS doi, source AS source_id FROM documents""")
def extra(spark, sf):
    given = fx.papers(spark, sf).drop("doi").withColumn("extra", F.create_map(
        F.lit("JOURNAL"), F.concat(F.col("lang"), F.lit(" ")), F.lit("Doi"), F.concat(F.lit("doi:10.5555/"), "doc_id"),
        F.lit("SOURCE_ID"), F.lit("ignored"))).withColumn("source_id", F.col("batch_id"))
    return linkage.metadata_from_extra(given).select("doc_id", "journal", "doi", "source_id")
