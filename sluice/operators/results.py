"""Results as they leave the engine: cells normalized, rows capped, bytes bounded."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = "__place"


def cell(value: Column, kind: T.DataType) -> Column:
    """Times become ISO text in UTC with milliseconds, bytes base64, 64-bit integers and intervals text; arrays, maps
    and structs go by their parts; decimals become doubles."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, (T.LongType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
        return value.cast("string")
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: cell(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: cell(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(cell(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalized(df: DataFrame) -> DataFrame:
    return df.select(*(cell(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema.fields))


def columns_of(df: DataFrame) -> list[dict[str, Any]]:
    return [{"name": f.name, "nullable": f.nullable, "type": f.dataType.simpleString() or "unknown"} for f in df.schema.fields]


def row_cap(requested: int | None, limit: int) -> int:
    return min(requested, limit) if requested else limit


def js_number(value: Column) -> Column:
    """A double as JSON text of JavaScript has it: no zero fraction, plain digits from 1e-6 up to 1e21, ``1e+21`` and
    ``1.5e-7`` beyond, null for NaN and the infinities."""
    size, shown = F.abs(value), value.cast("string")
    wide = F.when(size >= 1e7, value.try_cast("decimal(38,16)")).otherwise(shown.try_cast("decimal(38,24)")).cast("string")
    wide = F.regexp_replace(F.regexp_replace(wide, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(shown, r"\.0(?=E|$)", ""), r"E(?!-)", "e+")
    return (
        F.when(F.isnan(value) | (size == float("inf")), F.lit("null"))
        .when(value == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), short)
        .when((size >= 1e-6) & (size < 1e21), wide)
        .otherwise(F.replace(short, F.lit("E-"), F.lit("e-")))
    )


def json_bytes(df: DataFrame) -> Column:
    """The bytes of a row as JSON text, nulls included."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    parts = [(js_number(F.col(quoted(c)).cast("double")) if c in doubles else F.col(quoted(c))).alias(c) for c in df.columns if c != PLACE]
    quotes = sum((F.when(F.col(quoted(c)).isNotNull(), 2).otherwise(0) for c in doubles), F.lit(0))
    return F.octet_length(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})) - quotes


def capped(df: DataFrame, rows: int) -> DataFrame:
    """The first rows in the order in which they come, with their place from 1 on. One task, of at most ``rows`` rows."""
    first = df.limit(rows).withColumn(PLACE, F.monotonically_increasing_id())
    return first.withColumn(PLACE, F.row_number().over(Window.orderBy(PLACE)))


def head(df: DataFrame, rows: int, seen: Observation) -> DataFrame:
    """The first rows of each task, ``rows`` at most, with their place; seen gets ``n``, the number of all rows, from the same
    read of the table."""
    return df.observe(seen, F.count("*").alias("n")).withColumn(PLACE, F.monotonically_increasing_id()).where(F.col(PLACE).bitwiseAND((1 << 33) - 1) < rows)


def first_of(head: DataFrame, rows: int) -> DataFrame:
    """capped() of a table, from its head()."""
    first = head.orderBy(PLACE).limit(rows)
    return first.withColumn(PLACE, F.row_number().over(Window.orderBy(PLACE)))


def bounded(df: DataFrame, most: int, lenient_first: bool = True) -> DataFrame:
    """The longest prefix by PLACE whose JSON array fits into ``most`` bytes; with lenient_first the first row is
    measured alone, without the brackets. Only rows that a cap let through come here. result_bytes: up to each row."""
    size, order = json_bytes(df), Window.orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    running = df.withColumn("__size", size).withColumn("__sum", F.sum("__size").over(order))
    fits = F.col("__sum") + F.col(PLACE) + 1 <= most
    if lenient_first:
        fits = F.when(F.col(PLACE) == 1, F.col("__size") <= most).otherwise(fits)
    every = F.min(fits.cast("int")).over(order) == 1
    return running.withColumn("__fits", every).where("__fits").withColumn("result_bytes", F.col("__sum") + F.col(PLACE) + 1).drop("__size", "__sum", "__fits")
