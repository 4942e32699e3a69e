"""English stemmer (the published Porter2 rules) for keyword terms, applied to arrays of words in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rule tables of the published algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
         "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
         "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
          "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
          "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
          "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, endings) -> str | None:
    return max((x for x in endings if word.endswith(x)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    found = _REGION.search(w)
    r1 = len(prefix) if prefix else found.end() if found else len(w)
    found = _REGION.search(w, r1)
    r2 = found.end() if found else len(w)

    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    # Past and progressive forms.
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[:-len(end)] + "ee"
    elif end and _VOWEL.search(w[:-len(end)]):
        w = w[:-len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _SHORT.search(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # Suffixes inside the first region.
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[:-len(end)]
        if (end == "ogi" and before.endswith("l")) or (end == "li" and before[-1:] in set("cdeghkmnrt")) or end not in ("ogi", "li"):
            w = before + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[:-len(end)] + STEP_3[end]
    # Suffixes inside the second region.
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[:-len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_words(words: pa.Array) -> pa.Array:
    """The distinct words of a batch are stemmed, the others by number."""
    found = pc.dictionary_encode(words.flatten())
    stems = pa.array([stem(w) for w in found.dictionary.to_pylist()], pa.string()).take(found.indices)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())]), stems, mask=words.is_null())


def english_stemmer(words: Column) -> Column:
    """Stem every word of an array column."""
    return _stem_words(words)
