"""Names, scalars and fingerprints of SQL text: in Python for single values, as expressions for columns."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a statement reads, as the scope of its columns' kinds.
SOURCE = r"(?i)\b(?:from|join)\s+([A-Za-z0-9_\[\]\".]+)"


def key_of(name: str) -> str:
    """A column's name as lower-case words joined by _."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return "_".join(re.findall(r"[a-z0-9]+", split.lower()))


def key_column(name: Column) -> Column:
    """key_of() of a column."""
    split = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(split, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def scalar(value: Column) -> Column:
    """The value as text without white space (Unicode's) around it; empty for null."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def sources_of(sql: str | None) -> list[str]:
    """The distinct names after FROM and JOIN, in order, lower-case, without the quotes around them."""
    found = {re.sub(r"^[\[`\"]+|[\]`\"]+$", "", m).lower() for m in re.findall(SOURCE, sql or "")}
    return sorted(found - {""})


def scope_of(sql: str | None) -> str:
    return "|".join(sources_of(sql)) or "__global__"


def scope_column(sql: Column) -> Column:
    """scope_of() of a column of SQL texts."""
    names = F.transform(F.regexp_extract_all(sql, F.lit(SOURCE), F.lit(1)), lambda s: F.lower(F.regexp_replace(s, "^[\\[`\"]+|[\\]`\"]+$", "")))
    joined = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda s: s != ""))), "|")
    return F.when(joined == "", F.lit("__global__")).otherwise(joined)


def sql_hash(sql: str | None) -> str | None:
    return hashlib.sha256(sql.encode()).hexdigest()[:16] if sql and sql.strip() else None


def sql_preview(sql: str | None) -> str | None:
    return " ".join(sql.split())[:160] if sql and sql.strip() else None


def sql_hash_column(sql: Column) -> Column:
    return F.when(scalar(sql) != "", F.substring(F.sha2(sql, 256), 1, 16))


def sql_preview_column(sql: Column) -> Column:
    return F.when(scalar(sql) != "", F.substring(scalar(F.regexp_replace(sql, r"(?U)\s+", " ")), 1, 160))


def metadata_value(value: Any) -> str | None:
    """A ticket or the like: trimmed; blank or no text counts as none."""
    return (value.strip() or None) if isinstance(value, str) else None


def json_in(text: str) -> Any:
    """The JSON in a model's answer: the whole of it, a fenced block, or what is between the outer braces or brackets."""
    text = text.strip()
    fenced = re.search(r"```json\s*(.*?)```", text, re.S | re.I) or re.search(r"```[^\n]*\n(.*?)```", text, re.S)
    candidates = [text if text[:1] in ("{", "[") or not fenced else fenced[1]]
    for opening, closing in ("{}", "[]"):
        a, b = candidates[0].find(opening), candidates[0].rfind(closing)
        if 0 <= a < b:
            candidates.append(candidates[0][a : b + 1])
    for candidate in candidates:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    raise ValueError("Provider response did not contain valid JSON.")
