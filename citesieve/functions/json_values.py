"""JSON replies as VARIANT columns: strict and lenient parsing, type tests, text form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesieve.functions.text import col


def strict_json(c) -> Column:
    """The reply as VARIANT; null when it is not JSON, repeats a key, or holds NaN or Infinity."""
    return F.try_parse_json(col(c))


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID; null when the value is absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']" if "'" not in key else f'$["{key}"]', "variant")


def as_text(v: Column) -> Column:
    """The string in a VARIANT, or null when it holds anything else."""
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_number(v: Column) -> Column:
    return F.when(kind_of(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))


def is_missing(v: Column) -> Column:
    """Absent or JSON null."""
    return v.isNull() | (kind_of(v) == "VOID")


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def find(text):
        start = text.find("{") if text is not None else -1
        while start >= 0:
            try:
                value, _ = decoder.raw_decode(text, start)
                return json.dumps(value)
            except json.JSONDecodeError:
                start = text.find("{", start + 1)
        return None

    return texts.map(find)


def salvage_json(c) -> Column:
    """The reply when it is one JSON object, else the first object that decodes inside it.

    Sound replies are parsed in the JVM; only the others pass through the Arrow function.
    """
    text = col(c)
    whole = F.try_parse_json(text)
    sound = F.coalesce(kind_of(whole) == "OBJECT", F.lit(False))
    return F.when(sound, whole).otherwise(F.try_parse_json(_first_object(F.when(~sound, text))))


def stringify_value(v) -> Column:
    """Lists and objects as JSON text, scalars as plain text, null as null."""
    value = col(v)
    return F.when(is_missing(value), F.lit(None)).when(
        kind_of(value).isin("ARRAY", "OBJECT"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def valid_value(value: Column, value_type: Column) -> Column:
    """Strict type test: 7.0 is not an integer and true is not a number."""
    kind = kind_of(value)
    # Spark types a JSON number with a fraction part as DECIMAL even when the fraction is zero.
    integer = kind == "BIGINT"
    texts = F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
    only_nulls = F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.is_variant_null(x))
    return (F.when(value_type == "integer", integer)
            .when(value_type == "number", integer | kind.isin("DECIMAL", "DOUBLE", "FLOAT"))
            .when(value_type == "boolean", kind == "BOOLEAN")
            .when(value_type == "array", texts & ~F.coalesce(only_nulls, F.lit(False)))
            .when(value_type == "string", kind == "STRING").otherwise(F.lit(False)))
