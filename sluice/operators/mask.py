"""Masking of results: one projection, from the kind of each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.masks import masked
from sluice.functions.text import key_of, scalar
from sluice.operators import classify
from sluice.operators.classify import CODE_WORDS, KindCache, Profile, has_words, is_code, kind_by_name, safe_by_name
from sluice.operators.results import PLACE, quoted
from sluice.functions.text import scope_of


def masked_cell(field: T.StructField, salt: str, kinds: dict[str, str], known: dict[str, Profile], cached: str | None) -> Column:
    """A column's values masked by its kind. Without one: kept if the name or the profile is technical, or (per value)
    if a technical name holds a code; other text is masked as text, other values are kept. Nested values are masked
    as the text of their JSON."""
    column, key = F.col(quoted(field.name)), key_of(field.name)
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    value = F.to_json(column) if nested else column.cast("string")
    kind = kinds.get(key) or cached or kind_by_name(field.name)
    if kind == classify.NONE:
        return column
    if kind:
        return masked(kind, salt, key, value)
    p = known.get(key)
    if safe_by_name(field.name) or p and (p.flag_like or p.code_like or p.enum_like):
        return column
    if not nested and not isinstance(field.dataType, T.StringType):
        return column
    keep = scalar(value) == ""
    if has_words(field.name, CODE_WORDS):
        keep = keep | is_code(scalar(value))
    return F.when(keep, value).otherwise(masked("text", salt, key, value))


def masked_frame(df: DataFrame, salt: str, kinds: dict[str, str] | None = None, known: dict[str, Profile] | None = None, cache: KindCache | None = None, sql: str | None = None) -> DataFrame:
    """df with its sensitive columns masked: one projection, no shuffle, whatever the number of rows."""
    out = []
    for f in df.schema.fields:
        cached = cache.get(scope_of(sql), key_of(f.name)) if cache else None
        out.append(F.col(quoted(f.name)) if f.name == PLACE or not key_of(f.name) else masked_cell(f, salt, kinds or {}, known or {}, cached).alias(f.name))
    return df.select(*out)
