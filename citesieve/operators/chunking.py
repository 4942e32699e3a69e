"""Markdown documents to chunks.

A document is one row and stays one row until its chunks are exploded: blocks, heading paths,
captions and sentence windows are built-in array expressions, so chunking is a map-only stage
with no shuffle, however large the corpus or however skewed its sources.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesieve.functions.text import col, is_numeric_cell, is_ref_section, token_count
from citesieve.session import compute_once

# Tag names that open an HTML block, and the patterns that open the other blocks.
BLOCK_TAGS = ("address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|"
              "head|header|hr|html|iframe|li|link|main|menu|meta|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul")
HTML_START = rf"(?i)^ {{0,3}}(?:</?(?:{BLOCK_TAGS})(?:[\s/>]|$)|<!--)"
FENCE = r"(?m)^ {0,3}(?:```|~~~)[^\n]*$"
HEADING = r"^ {0,3}#{1,6}(?:[ \t]|$)"
ITEM = r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+"
IMAGE = r"!\[([^\]]*)\]\(\s*<?([^)\s>]*)>?[^)]*\)"
CUT = "\x01"


@dataclass(frozen=True)
class ChunkConfig:
    """Limits in tokens. ``counter`` and ``splitter`` are Column functions (text -> int, text -> array)."""

    max_tokens: int = 256
    min_tokens: int = 5
    overlap_tokens: int = 50
    caption_max_tokens: int = 45
    level: str = "paragraph"
    counter: Callable[[Column], Column] = token_count
    splitter: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.level not in ("sentence", "paragraph"):
            raise ValueError("level must be sentence or paragraph")
        if not 0 <= self.overlap_tokens < self.max_tokens or not 0 < self.min_tokens <= self.max_tokens:
            raise ValueError("overlap must be below the maximum, and the minimum within it")


# --- blocks ----------------------------------------------------------------------------------

def _where(text: Column, marks: str, change: Callable[[Column], Column]) -> Column:
    """``change`` of a text that holds any of the characters ``marks``, which its pattern needs; other texts are not searched by pattern."""
    def one(t: Column) -> Column:
        held = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            held = held | F.contains(t, F.lit(m))
        return F.when(held, change(t)).otherwise(t)

    return F.transform(F.array(text), one)[0]


def _replaced(text: Column, marks: str, pattern: str, keep: str) -> Column:
    return _where(text, marks, lambda t: F.regexp_replace(t, pattern, keep))


def inline_text(c: Column) -> Column:
    """Text of a block without inline markup; line breaks and markup edges leave the spaces of joined pieces."""
    text = _replaced(c, "\n", r"[ \t]*\n[ \t]*", "   ")
    for mark, pattern, keep in [
        ("`", r"(`+)([^`]+)\1", " $2 "), ("[", r"(?<!!)\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", " $1 "),
        ("*", r"(\*{1,3})(?=\S)([^*]*[^*\s])\1", " $2 "), ("_", r"(?<!\w)(_{1,2})(?=\S)([^_]*[^_\s])\1(?!\w)", " $2 "),
        ("\\", r"\\([!-/:-@\[-`{-~])", "$1"),
    ]:
        text = _replaced(text, mark, pattern, keep)
    return F.trim(text)


def _mark(segment: Column) -> Column:
    """Put a cut before and after every block of a segment that holds no fenced code."""
    text = _replaced(segment, "=", r"(?m)^([^\n#>|\-+*][^\n]*)\n {0,3}=+[ \t]*$", f"{CUT}# $1{CUT}")
    text = _replaced(text, "-", r"(?m)^([^\n#>|\-+*][^\n]*)\n {0,3}-+[ \t]*$", f"{CUT}## $1{CUT}")
    text = _replaced(text, "-*_", r"(?m)^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", CUT)
    text = _replaced(text, "#", r"(?m)^( {0,3}#{1,6}(?:[ \t][^\n]*)?)$", f"{CUT}$1{CUT}")
    text = F.regexp_replace(text, r"(?m)^(?=[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S)", CUT)
    text = _replaced(text, "<", rf"(?im)^(?= {{0,3}}(?:<(?:{BLOCK_TAGS})(?:[\s/>]|$)))", CUT)
    return _replaced(text, "\n", r"\n[ \t]*\n", CUT)


def _block(raw: Column, counter: Callable[[Column], Column]) -> Column:
    """Classify one piece of text; the kinds short and paragraph are told apart by tokens later."""
    kind = (F.when(raw.rlike(HEADING), "heading").when(raw.rlike(HTML_START), F.when(F.contains(F.lower(raw), F.lit("<table")), "table").otherwise("html"))
            .when(raw.rlike(ITEM), "list_item").when(raw.rlike(r"^(?: {4}|\t)"), "code").when(F.contains(raw, F.lit("![")) & raw.rlike(IMAGE), "image")
            .when(F.contains(raw, F.lit("$$")) & F.trim(raw).rlike(r"^\$\$[\s\S]*\$\$$"), "formula").otherwise("paragraph"))
    # A one-element transform names the kind, so that it is found once.
    return F.transform(F.array(kind), lambda k: _as_kind(raw, k))[0]


def _as_kind(raw: Column, kind: Column) -> Column:
    heading, item, code, image = (kind == x for x in ("heading", "list_item", "code", "image"))
    alt = F.element_at(F.regexp_extract_all(raw, F.lit(IMAGE), F.lit(1)), -1)
    url = F.element_at(F.regexp_extract_all(raw, F.lit(IMAGE), F.lit(2)), -1)
    beside = inline_text(F.regexp_replace(raw, IMAGE, ""))
    squeezed = F.trim(F.regexp_replace(raw, r"\n", " "))
    text = (F.when(heading, inline_text(F.regexp_replace(F.regexp_replace(raw, r"^ {0,3}#{1,6}[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t]*$", "")))
            .when(kind.isin("html", "table"), squeezed).when(item, inline_text(F.regexp_replace(raw, ITEM, "")))
            .when(code, F.trim(F.regexp_replace(raw, r"(?m)^(?: {4}|\t)", "")))
            .when(image, F.array_join(F.filter(F.array(F.trim(alt), beside), lambda x: x != ""), " "))
            .when(kind == "formula", F.trim(F.regexp_replace(F.trim(raw), r"^\$\$|\$\$$", "")))
            .otherwise(inline_text(raw)))
    return F.struct(
        kind.alias("kind"), F.when(heading, F.length(F.regexp_extract(raw, r"^ {0,3}(#{1,6})", 1))).otherwise(0).alias("level"),
        F.when(item, F.length(F.regexp_extract(raw, r"^([ \t]*)", 1))).otherwise(0).alias("indent"), text.alias("text"),
        F.when(kind == "table", squeezed).alias("raw"), F.when(image, url).alias("image_url"))


def blocks_of(text, counter: Callable[[Column], Column] = token_count) -> Column:
    """Ordered blocks (kind, level, indent, text, raw, image_url) of a markdown text."""
    segments = F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), FENCE)

    def parts(segment: Column, i: Column) -> Column:
        pieces = F.filter(F.split(_mark(segment), CUT), lambda p: p.rlike(r"\S"))
        pieces = F.transform(pieces, lambda p: F.regexp_replace(p, r"\A\n+|\s+\z", ""))
        found = F.transform(pieces, lambda p: _block(p, counter))
        code = F.struct(F.lit("code").alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("indent"), F.trim(F.regexp_replace(
            segment, r"\A\n|\n\z", "")).alias("text"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("image_url"))
        return F.when(i % 2 == 1, F.array(code)).otherwise(found)

    return F.flatten(F.transform(segments, parts))


def split_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block_ix, kind, level, indent, text, raw, image_url)."""
    return docs.select("doc_id", F.posexplode(blocks_of(text)).alias("block_ix", "_b")).select("doc_id", "block_ix", "_b.*")


# --- tables ----------------------------------------------------------------------------------

def _cells(row: Column, tag: str) -> Column:
    cells = F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(cells, cell_text)


def cell_text(c: Column) -> Column:
    """Text of a cell: tags out, the common character references decoded, trimmed."""
    text = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    # Decoded references; the ampersand is last.
    for name, value in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))


def table_text(html) -> Column:
    """Searchable text of a table: header cells on one line, then the non-numeric cells of every row."""
    source = col(html)
    headers = F.filter(_cells(source, "th"), lambda x: x != "")
    rows = F.transform(_rows(source), lambda r: F.array_join(F.filter(
        _cells(r, "td"), lambda x: (x != "") & ~is_numeric_cell(x)), " | "))
    lines = F.concat(F.array(F.array_join(headers, " | ")), rows)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def table_rows(html) -> Column:
    """All cells, tab between them and one line per row; rows without any text are left out."""
    rows = F.transform(_rows(col(html)), lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), cell_text))
    return F.array_join(F.transform(F.filter(rows, lambda r: F.exists(r, lambda x: x != "")), lambda r: F.array_join(r, "\t")), "\n")


# --- sentences -------------------------------------------------------------------------------

def split_sentences(text) -> Column:
    """Sentence boundaries after . ! or ? and space; trimmed, blanks removed."""
    return F.filter(F.transform(F.split(col(text), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def _counted(sentences: Column, counter: Callable[[Column], Column]) -> Column:
    return F.transform(sentences, lambda s: F.struct(s.alias("s"), counter(s).cast("int").alias("n")))


def _text_of(window: Column) -> Column:
    return F.array_join(F.transform(window, lambda x: x["s"]), " ")


_SENTENCES = "array<struct<s:string,n:int>>"


def pack_sentences(sentences: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Greedy windows over counted sentences; the next window starts with the trailing ones that fit the overlap.

    At least one sentence overlaps, unless the overlap and the new sentence would overflow.
    """
    empty = F.array().cast(_SENTENCES)

    def overlap(window: Column) -> Column:
        start = F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def take(state: Column, x: Column) -> Column:
            stop = state["full"] | ((F.size(state["kept"]) > 0) & (state["n"] + x["n"] > overlap_tokens))
            return F.when(stop, F.struct(state["kept"].alias("kept"), state["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
                F.struct(F.concat(F.array(x), state["kept"]).alias("kept"), (state["n"] + x["n"]).alias("n"),
                         (state["n"] + x["n"] >= overlap_tokens).alias("full")))

        return F.aggregate(F.reverse(window), start, take)

    def add(state: Column, x: Column) -> Column:
        over = (F.size(state["window"]) > 0) & (state["n"] + x["n"] > max_tokens)
        # One-element transforms name the overlap, so that it is computed once.
        started = F.transform(F.array(overlap(state["window"])), lambda o: F.when(
            o["n"] + x["n"] > max_tokens, F.struct(F.array(x).alias("window"), x["n"].alias("n"))).otherwise(
            F.struct(F.concat(o["kept"], F.array(x)).alias("window"), (o["n"] + x["n"]).alias("n"))))[0]
        return F.when(over, F.transform(F.array(started), lambda w: F.struct(
            F.concat(state["done"], F.array(_text_of(state["window"]))).alias("done"), w["window"].alias("window"), w["n"].alias("n")))[0]
        ).otherwise(F.struct(state["done"].alias("done"), F.concat(state["window"], F.array(x)).alias("window"),
                             (state["n"] + x["n"]).alias("n")))

    start = F.struct(F.array().cast("array<string>").alias("done"), empty.alias("window"), F.lit(0).alias("n"))
    return F.aggregate(sentences, start, add, lambda s: F.when(
        F.size(s["window"]) > 0, F.concat(s["done"], F.array(_text_of(s["window"])))).otherwise(s["done"]))


def sentence_chunks(sentences: Column, min_tokens: int, counter: Callable[[Column], Column] = token_count) -> Column:
    """Merge sentences forward until they reach the minimum; a short tail joins the chunk before it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("carry"))

    def add(state: Column, s: Column) -> Column:
        combined = F.when(state["carry"] != "", F.concat(state["carry"], F.lit(" "), s)).otherwise(s)
        return F.transform(F.array(combined), lambda c: F.when(
            counter(c) < min_tokens, F.struct(state["done"].alias("done"), c.alias("carry"))).otherwise(
            F.struct(F.concat(state["done"], F.array(c)).alias("done"), F.lit("").alias("carry"))))[0]

    def finish(s: Column) -> Column:
        n = F.size(s["done"])
        tail = F.concat(F.get(s["done"], n - 1), F.lit(" "), s["carry"])
        return (F.when(s["carry"] == "", s["done"]).when(n == 0, F.array(s["carry"]))
                .otherwise(F.concat(F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(tail))))

    return F.aggregate(sentences, start, add, finish)


# --- sections --------------------------------------------------------------------------------

def spans_of(blocks: Column) -> Column:
    """Blocks grouped under their headings: (level, heading, body); the first span has no heading."""
    indexed = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b["kind"].alias("kind"), b["level"].alias("level"), b["text"].alias("text")))
    heads = F.filter(indexed, lambda b: b["kind"] == "heading")
    start = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("level"), F.lit("").alias("text")))
    marks = F.concat(start, F.transform(heads, lambda h: F.struct(h["i"].alias("i"), h["level"].alias("level"), h["text"].alias("text"))))

    def span(marked: Column, size: Column) -> Column:
        return F.transform(marked, lambda m, j: F.struct(
            m["level"].alias("level"), m["text"].alias("heading"), F.slice(
                blocks, m["i"] + 2, F.coalesce(F.get(marked, j + 1)["i"], size) - m["i"] - 1).alias("body")))

    return F.transform(F.array(marks), lambda m: span(m, F.size(blocks)))[0]


_LEVELS = "array<struct<level:int,text:string>>"


def section_paths(spans: Column) -> Column:
    """Path of every span from (level, heading, emits).

    A heading drops the same and deeper levels and any level 1; a heading of the level of the one
    before it stays beside it when no chunk came between. Spans under references emit nothing.
    """
    start = F.struct(F.array().cast(_LEVELS).alias("stack"), F.array().cast("array<string>").alias("paths"), F.lit(False).alias("emitted"))

    def push(state: Column, s: Column) -> Column:
        top = F.get(state["stack"], F.size(state["stack"]) - 1)
        beside = F.coalesce(top["level"] == s["level"], F.lit(False)) & ~state["emitted"]
        new = F.array(F.struct(s["level"].alias("level"), s["heading"].alias("text")))
        stack = F.when(s["level"] == 0, state["stack"]).when(beside, F.concat(state["stack"], new)).otherwise(
            F.concat(F.filter(state["stack"], lambda x: (x["level"] < s["level"]) & (x["level"] >= 2)), new))

        def settle(k: Column) -> Column:
            path = F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: x["text"]), " > ")).otherwise("Preamble")
            return F.struct(k.alias("stack"), F.concat(state["paths"], F.array(path)).alias("paths"),
                            (s["emits"] & ~is_ref_section(path)).alias("emitted"))

        return F.transform(F.array(stack), settle)[0]

    return F.aggregate(spans, start, push, lambda s: s["paths"])


def section_path(docs: DataFrame, text: str = "text", cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_id, span_ix, level, heading, section, n_blocks) of every document."""
    return _with_sections(docs, text, cfg).select("doc_id", F.posexplode("_sections").alias("span_ix", "_s")).select(
        "doc_id", "span_ix", "_s.level", "_s.heading", "_s.section", F.size("_s.body").alias("n_blocks"))


# --- captions and assembly -------------------------------------------------------------------

CARRIERS = ["short", "paragraph", "formula", "html", "table"]
_PIECE = "kind:string,text:string,raw:string,image_url:string,tokens:int,paragraph:int"


def _measured(blocks: Column, cfg: ChunkConfig) -> Column:
    """Blocks with token counts; short paragraphs become caption candidates, outer list items of nested lists drop out."""
    def measure(b: Column, i: Column) -> Column:
        after = F.get(blocks, i + 1)
        nested = (b["kind"] == "list_item") & F.coalesce((after["kind"] == "list_item") & (after["indent"] >= b["indent"] + 2), F.lit(False))
        text = F.when(b["kind"] == "table", table_text(b["raw"])).when(nested, "").otherwise(b["text"])
        counted = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), cfg.counter(t).cast("int").alias("n")))[0]
        return F.transform(F.array(counted), lambda c: F.struct(
            F.when((b["kind"] == "paragraph") & (c["n"] < cfg.caption_max_tokens), "short").otherwise(b["kind"]).alias("kind"),
            b["level"].alias("level"), c["t"].alias("text"), b["raw"].alias("raw"), b["image_url"].alias("image_url"), c["n"].alias("tokens")))[0]

    return F.transform(blocks, measure)


def carry_captions(body: Column, cfg: ChunkConfig) -> Column:
    """Pieces of a span in order. A short paragraph is held: it prefixes the next table or formula, or else
    becomes a paragraph of its own before the next block that is not an image, code or list item.
    """
    indexed = F.transform(body, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    carriers = F.filter(indexed, lambda x: x["b"]["kind"].isin(*CARRIERS))
    others = F.filter(indexed, lambda x: ~x["b"]["kind"].isin(*CARRIERS))

    def piece(b: Column, kind, text: Column, tokens: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), b["raw"].alias("raw"), b["image_url"].alias("image_url"), tokens.alias("tokens"))

    def emitted(x: Column, held: Column) -> Column:
        b = x["b"]
        waits = F.coalesce(held["b"]["kind"] == "short", F.lit(False))
        caption = held["b"]["text"]
        merges = b["kind"].isin("table", "formula")
        text = F.when(waits & merges, F.when(b["text"] != "", F.concat(caption, F.lit("\n"), b["text"])).otherwise(
            F.when(b["kind"] == "formula", F.concat(caption, F.lit("\n"))).otherwise(caption))).otherwise(b["text"])
        own = F.array(piece(b, b["kind"], text, b["tokens"]))
        before = F.array(piece(held["b"], F.lit("caption"), caption, held["b"]["tokens"]))
        nothing = F.slice(before, 1, 0)
        return F.concat(F.when(waits & ~merges, before).otherwise(nothing), F.when(b["kind"] == "short", nothing).otherwise(own))

    def assemble(cs: Column) -> Column:
        last = F.get(cs, F.size(cs) - 1)
        carried = F.transform(cs, lambda x, j: F.struct(x["i"].alias("i"), emitted(x, F.get(cs, j - 1)).alias("out")))
        single = F.transform(others, lambda x: F.struct(x["i"].alias("i"), F.array(
            piece(x["b"], x["b"]["kind"], x["b"]["text"], x["b"]["tokens"])).alias("out")))
        tail = F.filter(F.array(F.struct(F.lit(2147483647).alias("i"), F.array(
            piece(last["b"], F.lit("caption"), last["b"]["text"], last["b"]["tokens"])).alias("out"))),
            lambda t: F.coalesce(last["b"]["kind"] == "short", F.lit(False)))
        return F.flatten(F.transform(F.array_sort(F.concat(carried, single, tail)), lambda x: x["out"]))

    return F.transform(F.array(carriers), assemble)[0]


def drop_short(pieces: Column, cfg: ChunkConfig) -> Column:
    """Paragraph, html, code and list-item pieces below the minimum go; tables, formulas, images and held captions stay."""
    exempt = ["table", "formula", "image", "caption"]
    return F.filter(pieces, lambda p: ((p["text"] != "") | (p["kind"] == "formula")) & (p["kind"].isin(*exempt) | (p["tokens"] >= cfg.min_tokens)))


def _with_sections(docs: DataFrame, text: str, cfg: ChunkConfig) -> DataFrame:
    """Add ``_sections``: spans with their pieces and section paths."""
    df = compute_once(docs.select("doc_id", text), {"_blocks": blocks_of(text, cfg.counter)})
    df = compute_once(df.drop(text), {"_blocks": _measured(F.col("_blocks"), cfg)})
    df = compute_once(df, {"_spans": spans_of(F.col("_blocks"))})
    emitting = F.transform("_spans", lambda s: F.struct(
        s["level"].alias("level"), s["heading"].alias("heading"), s["body"].alias("body"),
        drop_short(carry_captions(s["body"], cfg), cfg).alias("pieces")))
    df = compute_once(df.drop("_blocks"), {"_spans": emitting})
    paths = section_paths(F.transform("_spans", lambda s: F.struct(
        s["level"].alias("level"), s["heading"].alias("heading"), (F.size(s["pieces"]) > 0).alias("emits"))))
    df = compute_once(df, {"_paths": paths})
    return df.withColumn("_sections", F.zip_with("_spans", "_paths", lambda s, p: F.struct(
        s["level"].alias("level"), s["heading"].alias("heading"), p.alias("section"), s["body"].alias("body"), s["pieces"].alias("pieces"))))


def drop_reference_sections(sections: Column) -> Column:
    return F.filter(sections, lambda s: ~is_ref_section(s["section"]))


def chunk_documents(docs: DataFrame, cfg: ChunkConfig = ChunkConfig(), text: str = "text") -> DataFrame:
    """(doc_id, chunk_ix, id, section, kind, text, tokens, raw, image_url, paragraph_id) of every document."""
    splitter = cfg.splitter or split_sentences
    df = _with_sections(docs, text, cfg)
    pieces = F.flatten(F.transform(drop_reference_sections(F.col("_sections")), lambda s: F.transform(
        s["pieces"], lambda p: p.withField("section", s["section"]))))
    df = compute_once(df.select("doc_id", pieces.alias("_pieces")), {"_pieces": F.col("_pieces")})
    is_text = lambda p: p["kind"].isin("paragraph", "caption")
    # Paragraph numbers, in order, of the pieces that sentence level cuts.
    numbered = F.transform("_pieces", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    order = F.transform(F.filter(numbered, lambda x: is_text(x["p"])), lambda x: x["i"])
    df = compute_once(df, {"_order": order})

    def texts(p: Column) -> Column:
        whole = F.array(p["text"])
        if cfg.level == "sentence":
            return F.when(is_text(p), sentence_chunks(splitter(p["text"]), cfg.min_tokens, cfg.counter)).otherwise(whole)
        # A one-element transform names the sentences, so that a text is split once.
        packed = F.transform(F.array(splitter(p["text"])), lambda sentences: F.when(
            F.size(sentences) > 1, pack_sentences(_counted(sentences, cfg.counter), cfg.max_tokens, cfg.overlap_tokens)).otherwise(whole))[0]
        return F.when((p["kind"] == "paragraph") & (p["tokens"] > cfg.max_tokens), packed).otherwise(whole)

    paragraph = F.lit(None).cast("string")
    made = F.flatten(F.transform("_pieces", lambda p, i: F.transform(texts(p), lambda t: F.struct(
        p["section"].alias("section"), F.when(p["kind"] == "caption", "paragraph").otherwise(p["kind"]).alias("kind"), F.trim(t).alias("text"),
        p["raw"].alias("raw"), p["image_url"].alias("image_url"),
        (F.when(is_text(p), F.concat(F.lit("p"), F.array_position("_order", i) - 1)) if cfg.level == "sentence" else paragraph).alias("paragraph_id")))))
    out = df.select("doc_id", F.posexplode(made).alias("chunk_ix", "_c"))
    return out.select("doc_id", "chunk_ix", F.concat(F.lit("chunk_"), "chunk_ix").alias("id"), "_c.section", "_c.kind", "_c.text",
                      cfg.counter(F.col("_c.text")).alias("tokens"), "_c.raw", "_c.image_url", "_c.paragraph_id")


def documents_without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk at all: an error of that document only."""
    return docs.select("doc_id").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").withColumn(
        "error", F.lit("no indexable chunks"))
