"""Distinct counts from stored sketches: one for each day and group, merged on request; a day is counted once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage


@dataclass
class DailySketches:
    """Sketches (HyperLogLog, Spark's own) of the distinct values of a column by day and groups, in a folder of Parquet.

    A batch of days is a folder of its own, sorted by day, and counts once its entry is in ``log``; a day that a batch
    has isn't counted again, so a batch that comes a second time reads which days it has and nothing else. bits: a sketch
    has 2**bits cells at most, and a relative error of about 0.83 / sqrt(2**bits).
    """

    spark: SparkSession
    path: str
    value: str
    groups: list[str]
    bits: int = 14

    def days(self) -> dict[str, str]:
        """The batch of each day that is in."""
        names = storage.places(self.spark, f"{self.path}/log")
        rows = self.spark.read.schema("batch string, days array<string>").json([f"{self.path}/log/{n}" for n in names]).collect() if names else []
        return {day: r.batch for r in rows if r.batch for day in r.days}

    def add(self, rows: DataFrame, day: str) -> list[str]:
        """Counts the days of rows (by a column of dates or times) that aren't in yet, and tells which these were. Null
        days are left out, null values aren't counted; null groups are groups of their own."""
        place = len(storage.places(self.spark, f"{self.path}/log"))
        name = f"batch-{place:09d}-{uuid.uuid4().hex}"
        known = list(self.days())
        dated = rows.withColumn("__day", F.col(day).cast("date").cast("string")).where(F.col("__day").isNotNull())
        fresh = dated.where(~F.col("__day").isin(known)) if known else dated
        new = sorted(r[0] for r in fresh.select("__day").distinct().collect())
        if not new:
            return []
        sketched = fresh.groupBy(F.col("__day").alias("day"), *self.groups).agg(F.hll_sketch_agg(self.value, F.lit(self.bits)).alias("sketch"))
        sketched.repartitionByRange("day").sortWithinPartitions("day").write.parquet(f"{self.path}/{name}")
        if not storage.take_place(self.spark, f"{self.path}/log/{place:09d}.json", json.dumps({"batch": name, "days": new})):
            raise RuntimeError("Another writer added days; add again.")
        return new

    def counts(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(groups, about): distinct values from day first to day last, both included. Reads sketches of these days alone."""
        days = {d: b for d, b in self.days().items() if (first is None or d >= first) and (last is None or d <= last)}
        if not days:
            raise ValueError("No day is in.")
        stored = self.spark.read.parquet(*(f"{self.path}/{batch}" for batch in sorted(set(days.values()))))
        return stored.where(F.col("day").between(min(days), max(days))).groupBy(*self.groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
