"""As-of joins for keys of any size: each row with the last one of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE, TIME, SEEN, MINE, CARRIED = "__slice", "__time", "__seen", "__mine", "__carried"


def asof_join(left: DataFrame, right: DataFrame, key: tuple[str, str], at: tuple[str, str], values: list[str], slices: int = 16) -> DataFrame:
    """The rows of left, with the columns ``values`` of right's last row of the same key at or before their time; of rows
    at the same time the one with the largest values. key and at: the columns of left and of right.

    A key's rows are dealt out by slices of time, so that one with much of the table is no single task's: each (key,
    slice) is sorted by itself, and what a slice begins with is the last value of the slices before it, from a table
    of one row for each (key, slice). Slices end at quantiles of the right side's times, so that they hold about equally
    many rows. Null keys and times find nothing, and the rows stay; repeated rows stay. Columns mustn't clash.
    """
    right = right.select(F.col(key[1]).alias("__key"), F.col(at[1]).alias(TIME), F.struct(*values).alias(SEEN)).where(F.col("__key").isNotNull() & F.col(TIME).isNotNull())
    shares = [k / slices for k in range(1, slices)]
    number = F.unix_micros(F.col(TIME).cast("timestamp")) if "timestamp" in dict(right.dtypes)[TIME] or dict(right.dtypes)[TIME] == "date" else F.col(TIME).cast("double")
    edges = sorted(set((right.agg(F.percentile_approx(number, shares, 10_000).alias("e")).first().e or []) if slices > 1 else []))
    of = F.lit(0)
    for edge in edges:
        of = of + (number >= F.lit(edge)).cast("int")
    empty = F.lit(None).cast(right.schema[SEEN].dataType)
    named = left.select(F.struct(*left.columns).alias(MINE), F.col(key[0]).alias("__key"), F.col(at[0]).alias(TIME))
    known = F.col("__key").isNotNull() & F.col(TIME).isNotNull()
    rows = named.where(known).select("__key", TIME, empty.alias(SEEN), MINE).union(right.select("__key", TIME, SEEN, F.lit(None).cast(named.schema[MINE].dataType))).withColumn(SLICE, of)
    ends = right.withColumn(SLICE, of).groupBy("__key", SLICE).agg(F.max(F.struct(TIME, SEEN)).alias("x")).select("__key", (F.col(SLICE) + 1).alias(SLICE), F.col(f"x.{SEEN}").alias(CARRIED))
    # of every slice that a key has on either side: the last value of those before it
    needed = rows.select("__key", SLICE).distinct().withColumn(CARRIED, empty).union(ends)
    before = Window.partitionBy("__key").orderBy(SLICE)
    carried = needed.groupBy("__key", SLICE).agg(F.max(CARRIED).alias(CARRIED)).withColumn(CARRIED, F.last(CARRIED, ignorenulls=True).over(before))
    within = Window.partitionBy("__key", SLICE).orderBy(TIME, F.col(MINE).isNotNull(), SEEN).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(SEEN, F.last(SEEN, ignorenulls=True).over(within)).where(F.col(MINE).isNotNull())
    joined = found.join(carried, ["__key", SLICE], "left").select(f"{MINE}.*", F.coalesce(SEEN, CARRIED).alias(SEEN))
    rest = named.where(~known).select(f"{MINE}.*", empty.alias(SEEN))
    return joined.union(rest).select(*left.columns, *(F.col(f"{SEEN}.`{v}`").alias(v) for v in values))
