"""Queries of the chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from citesieve.operators import chunking as ch
from citesieve.plans import fixtures as fx
from citesieve.plans.register import registry

QUERIES, ORACLES, register = registry()


def markdown(spark, sf):
    """Pages as markdown: headings, paragraphs, and the footer under a references heading."""
    h = F.regexp_replace("html", r"(?is)<head.*?</head>|<script.*?</script>|<nav.*?</nav>", "")
    h = F.regexp_replace(h, r"[*#_`$\[\]\\%~+]", "")
    h = F.regexp_replace(h, r"(?i)<h1[^>]*>", "\n\n# ")
    h = F.regexp_replace(h, r"(?i)<footer[^>]*>", "\n\n# References\n\n")
    h = F.regexp_replace(h, r"(?i)</?(?:p|div|br|h1)\b[^>]*>", "\n\n")
    return fx.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(h, r"<[^>]*>", "").alias("text"))


SQL_BLOCKS = r"""md AS (
  SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<head.*?</head>|<script.*?</script>|<nav.*?</nav>', '', 'g'), '[*#_`$\[\]\\%~+]', '', 'g'), '(?i)<h1[^>]*>', chr(10) || chr(10) || '# ', 'g'),
    '(?i)<footer[^>]*>', chr(10) || chr(10) || '# References' || chr(10) || chr(10), 'g'), '(?i)</?(?:p|div|br|h1)\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
raw AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda x: regexp_matches(x, '\S'))) AS piece,
        generate_subscripts(list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda x: regexp_matches(x, '\S')), 1) - 1 AS block_ix FROM md),
blocks AS (
  SELECT doc_id, block_ix, CASE WHEN starts_with(ltrim(piece, chr(10)), '# ') THEN 'heading' ELSE 'paragraph' END AS kind,
         trim(regexp_replace(regexp_replace(trim(piece, chr(10) || ' '), '[ \t]*\n[ \t]*', '   ', 'g'), '^# ', '')) AS text FROM raw),
counted AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]'))::INT AS tokens,
            coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ix), 'Preamble') AS section FROM blocks)"""

WIDE = ch.ChunkConfig(max_tokens=100_000, min_tokens=5, overlap_tokens=50, caption_max_tokens=1)


@register("split_blocks", fx.sql(SQL_BLOCKS, select="SELECT doc_id, block_ix::INT AS block_ix, kind, text FROM blocks"))
def blocks(spark, sf):
    return ch.split_blocks(markdown(spark, sf)).select("doc_id", "block_ix", "kind", "text")


@register("section_path", fx.sql(SQL_BLOCKS, """heads AS (
  SELECT doc_id, any_value(text) FILTER (text <> 'References') AS h1,
         (SELECT count(*) FROM counted c WHERE c.doc_id = b.doc_id AND kind = 'paragraph' AND tokens >= 5 AND section NOT IN ('Preamble', 'References')) AS emitted
  FROM blocks b WHERE kind = 'heading' GROUP BY doc_id)""", select="""
SELECT doc_id, CASE WHEN section = 'References' AND emitted = 0 THEN h1 || ' > References' ELSE section END AS section,
       count(*) FILTER (kind = 'paragraph')::INT AS n_blocks FROM counted LEFT JOIN heads USING (doc_id) GROUP BY ALL
UNION ALL SELECT doc_id, 'Preamble', 0 FROM md WHERE doc_id NOT IN (SELECT doc_id FROM counted WHERE section = 'Preamble')"""))
def sections(spark, sf):
    return ch.section_path(markdown(spark, sf), cfg=WIDE).select("doc_id", "section", "n_blocks")


@register("drop_reference_sections", fx.sql(SQL_BLOCKS, select=r"""
SELECT doc_id, count(*) AS kept FROM (SELECT DISTINCT doc_id, section FROM counted UNION SELECT doc_id, 'Preamble' FROM md)
WHERE NOT regexp_matches(lower(section), 'reference|bibliography|works cited') GROUP BY ALL"""))
def without_references(spark, sf):
    with_sections = ch._with_sections(markdown(spark, sf), "text", WIDE)
    return with_sections.select("doc_id", F.size(ch.drop_reference_sections(F.col("_sections"))).cast("bigint").alias("kept"))


@register("drop_short", fx.sql(SQL_BLOCKS, select="""
SELECT doc_id, count(*) AS kept FROM counted WHERE kind = 'paragraph' AND section <> 'References' AND tokens >= 12 GROUP BY ALL"""))
def short(spark, sf):
    cfg = ch.ChunkConfig(max_tokens=100_000, min_tokens=12, caption_max_tokens=1)
    return ch.chunk_documents(markdown(spark, sf), cfg).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@register("chunk_pages", fx.sql(SQL_BLOCKS, select="""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) - 1)::INT AS chunk_ix, section, kind, text, tokens
FROM counted WHERE kind = 'paragraph' AND section <> 'References' AND tokens >= 5"""))
def chunked(spark, sf):
    return ch.chunk_documents(markdown(spark, sf), WIDE).select("doc_id", "chunk_ix", "section", "kind", "text", "tokens")


@register("split_sentences", r"""
SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS sentences FROM documents""")
def sentences(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.size(ch.split_sentences("text")).alias("sentences"))


@register("pack_sentences")
def packed(spark, sf):
    counted = F.transform(ch.split_sentences("text"), lambda s: F.struct(s.alias("s"), ch.token_count(s).alias("n")))
    out = fx.table(spark, sf, "documents").select("doc_id", ch.pack_sentences(counted, 60, 12).alias("w"))
    return out.select("doc_id", F.posexplode("w").alias("window_ix", "text"))


@register("sentence_chunks")
def merged(spark, sf):
    out = fx.table(spark, sf, "documents").select("doc_id", ch.sentence_chunks(ch.split_sentences("text"), 8).alias("w"))
    return out.select("doc_id", F.posexplode("w").alias("chunk_ix", "text"))


@register("table_text", """
SELECT l_orderkey, string_agg('qq ' || l_linenumber || ' | ' || l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text,
       string_agg('qq ' || l_linenumber || chr(9) || l_returnflag || l_linestatus || chr(9) || l_linenumber, chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus) AS rows
FROM lineitem GROUP BY ALL""")
def tables(spark, sf):
    cells = F.concat(F.lit("<tr><td>qq "), "l_linenumber", F.lit("</td><TD class='x'> <b>"), "l_returnflag", F.lit("</b>"), "l_linestatus",
                     F.lit("</td><td>"), "l_linenumber", F.lit("</td></tr>"))
    html = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("r")))).alias("s"))
    body = html.select("l_orderkey", F.concat(F.lit("<table>"), F.array_join(F.transform("s", lambda x: x["r"]), ""), F.lit("</table>")).alias("h"))
    return body.select("l_orderkey", ch.table_text("h").alias("text"), ch.table_rows("h").alias("rows"))


@register("chunk_documents")
def chunk_prose(spark, sf):
    return ch.chunk_documents(fx.table(spark, sf, "documents")).select("doc_id", "chunk_ix", "section", "kind", "tokens")


@register("carry_captions")
def captions(spark, sf):
    """Every document as a caption, a table and its prose under headings of one level."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("# T\n\n## M\n\n"), F.regexp_replace(F.substring_index("text", "\n", 1), r"[*#_`$\[\]<>|]", ""), F.lit("\n\n<table><tr><td>"), "lang",
        F.lit(" cell</td></tr></table>\n\n### A\n\n### B\n\n"), "text").alias("text"))
    return ch.chunk_documents(docs).select("doc_id", "chunk_ix", "section", "kind", "tokens")
