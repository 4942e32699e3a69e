"""Text expressions. Everything but the exact title key is a built-in Column expression."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters whose Unicode case folding is longer than (or differs from) their lower case.
FOLDED = [
    ("ß", "ss"), ("ς", "σ"), ("ŉ", "ʼn"), ("ſ", "s"),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
]

_EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_SPACE = r"\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Whitespace that is not one plain space: words of most texts are one space apart, which needs no replacement.
_LAYOUT = rf" [ {_SPACE}]+|[{_SPACE}][ {_SPACE}]*"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(c) -> Column:
    """Null becomes '', whitespace (Unicode) is trimmed from both ends."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), _EDGE_SPACE, ""), F.lit(""))


def blank_to_null(c) -> Column:
    return F.nullif(clean_text(c), F.lit(""))


def fold(c) -> Column:
    """Case folding: lower case plus the letters where folding and lower case part ways."""
    special = "[" + "".join(source for source, _ in FOLDED) + "]"

    def settle(folded: Column) -> Column:
        replaced = folded
        for source, target in FOLDED:
            replaced = F.replace(replaced, F.lit(source), F.lit(target))
        # Texts of one byte a character hold none of these letters.
        return F.when((F.octet_length(folded) > F.length(folded)) & folded.rlike(special), replaced).otherwise(folded)

    # A one-element transform names the lower-case text, so that it is made once.
    return F.transform(F.array(F.lower(col(c))), settle)[0]


def normalize_doi(c) -> Column:
    """Drop a resolver address or ``doi:`` prefix; the rest keeps its case."""
    return F.regexp_replace(clean_text(c), r"(?i)\A(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def doi_key(c) -> Column:
    return F.lower(normalize_doi(c))


def _simple_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"(?U)[\W_]+", " "))


@F.pandas_udf(T.StringType())
def _compatibility_title(values: pd.Series) -> pd.Series:
    def key(value):
        if value is None:
            return None
        return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", value).casefold()).strip()

    return values.map(key)


def normalized_title(c, exact: bool = True) -> Column:
    """Title key: compatibility form, case-folded, runs of non-word characters to one space.

    ASCII titles (where the two forms agree) never leave the JVM; with ``exact`` the others
    pass through an Arrow function because Spark has no NFKC built-in.
    """
    text = F.coalesce(col(c), F.lit(""))
    if not exact:
        return _simple_title(text)
    ascii_only = text.rlike(r"\A\p{ASCII}*\z")
    return F.coalesce(F.when(ascii_only, _simple_title(text)),
                      _compatibility_title(F.when(~ascii_only, text)))


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), _LAYOUT, " "))


def plain_layout(c) -> Column:
    """The form in which quotes are looked up: case folded, runs of whitespace as one space. Null counts as empty."""
    return fold(collapse(c))


def quote_in_text(quote, text, plain: bool = False) -> Column:
    """True when the quote occurs in the text, ignoring case and whitespace layout; ``plain`` texts went through :func:`plain_layout`."""
    return F.contains(col(text) if plain else plain_layout(text), plain_layout(quote))


def premise(title, abstract) -> Column:
    body = F.concat(F.lit("Title: "), clean_text(title), F.lit("\nAbstract: "), clean_text(abstract))
    return F.regexp_replace(body, _EDGE_SPACE, "")


def strip_references(c) -> Column:
    """Cut a markdown text at its first references heading; other texts are unchanged."""
    heading = r"(?im)^#+[^\S\n]*(?:references|bibliography|works cited)[^\S\n]*$"
    text = col(c)
    cut = F.regexp_replace(text, heading + r"[\s\S]*\z", "")
    return F.when(text.rlike(heading), F.regexp_replace(cut, r"(?U)\s+\z", "")).otherwise(text)


def is_ref_section(c) -> Column:
    return F.lower(col(c)).rlike("reference|bibliography|works cited")


def is_numeric_cell(c) -> Column:
    """Fewer than two ASCII letters."""
    return F.length(F.regexp_replace(col(c), "[^a-zA-Z]", "")) < 2


def is_safe_pdf_path(c) -> Column:
    """Relative, inside the folder, no drive or colon, and a ``.pdf`` suffix."""
    path = F.replace(col(c), F.lit("\\"), F.lit("/"))
    return (
        ~F.startswith(path, F.lit("/"))
        & ~F.contains(path, F.lit(":"))
        & ~path.rlike(r"(^|/)\.\.(/|$)")
        & path.rlike(r"(?i)[^/]\.pdf/*$")
    )


def token_count(c) -> Column:
    """Default token counter: words and single punctuation marks. Plug in another as a Column function."""
    return F.size(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def guard_formula(c) -> Column:
    """Prefix text a spreadsheet would evaluate with an apostrophe."""
    text = col(c)
    return F.when(text.rlike(r"(?U)\A\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def python_list(c) -> Column:
    """``['a', 'b']`` for an array of strings, ``None`` for null: the form prompts print."""
    quoted = F.transform(col(c), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.coalesce(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), F.lit("None"))
