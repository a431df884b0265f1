"""SimHash near-dedup: fingerprints, and links at few differing bits by a generalised pigeonhole index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.pairs import LEFT, RIGHT, compare, deal, hot_keys
from sluice.llm.shared import components, cut, forest, partitions

BITS = 64
SHINGLE = 4
SEED = 42
#: Rows of the fingerprint sample that parts and thresholds are chosen from.
SAMPLE = 2048
#: What a row that goes to a bucket costs, in comparisons.
ROW_COST = 60


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text: bit i is set if over half of its shingles' hashes have bit i."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found) - SHINGLE + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[: n - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp: the fingerprint's bits as a signed long. A text that is null, empty or without
    words has fingerprint zero; one of fewer words than a shingle has that of its whole sequence."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


class Plan(NamedTuple):
    """parts: the bits of each part; limits: the most differing bits that its probes allow (-1: it isn't probed)."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]


def group_bits(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Deals bits (a column each) to equal parts, so that correlated ones go together."""
    if len(bits) > 1:
        spread = bits - bits.mean(0)
        norm = np.sqrt((spread**2).sum(0))
        alike = np.abs(spread.T @ spread) / np.maximum(norm[:, None] * norm[None, :], 1e-9)
    else:
        alike = np.zeros((BITS, BITS))
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        start = max(left, key=lambda b: alike[b, left].sum())
        own = [start]
        left.remove(start)
        while len(own) < size:
            best = max(left, key=lambda b: alike[b, own].sum())
            own.append(best)
            left.remove(best)
        out.append(tuple(sorted(own)))
    return out


def choose(sample: np.ndarray, rows: int, distance: int) -> Plan:
    """The cheapest parts and limits by which every pair within ``distance`` bits meets in some part.

    If all parts i differ in over limits[i] bits, the whole differs in at least the sum of limits[i] + 1; so limits
    whose sum plus the number of parts is distance + 1 miss nothing. A dynamic programme over the parts picks the
    limits for which probes and the candidates that the sample lets expect are fewest.
    """
    as_bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    best: tuple[float, Plan] | None = None
    for count in range(1, distance + 2):
        parts = group_bits(as_bits, count)
        costs = []
        for part in parts:
            own = values_of(sample, part)
            apart = np.bitwise_count(own[:, None] ^ own[None, :])
            n = max(1, len(own) * (len(own) - 1))
            seen = [((apart <= t).sum() - len(own)) / n for t in range(distance + 1)]
            # candidates that the sample is too small to show: as of random bits
            chance = [sum(comb(len(part), d) for d in range(t + 1)) / 2 ** len(part) for t in range(distance + 1)]
            costs.append([0.0] + [ROW_COST * sum(comb(len(part), d) for d in range(t + 1)) + rows * max(seen[t], chance[t]) for t in range(distance + 1)])
        table: list[dict[int, tuple[float, tuple[int, ...]]]] = [{0: (0.0, ())}]
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (total, limits) in table[-1].items():
                for t in range(-1, distance + 1):
                    key = used + t + 1
                    if key <= distance + 1 and (key not in step or total + cost[t + 1] < step[key][0]):
                        step[key] = (total + cost[t + 1], (*limits, t))
            table.append(step)
        total, limits = table[-1][distance + 1]
        if best is None or total < best[0]:
            best = total, Plan(tuple(parts), limits)
    return best[1]


def values_of(fps: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """The bits of a part, packed, as unsigned numbers."""
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(part):
        out |= (fps >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out


def bucket_keys(fps: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, key, whether it is a probe): each row's own bucket of every part, then those that its probes visit."""
    rows = np.arange(len(fps))
    for index, (part, limit) in enumerate(zip(plan.parts, plan.limits)):
        if limit < 0:
            continue
        own = values_of(fps, part)
        for d in range(limit + 1):
            for flipped in combinations(range(len(part)), d):
                value = own ^ np.uint64(sum(1 << k for k in flipped))
                # parts of over 32 bits share a bucket's number with others now and then; all pairs are verified
                if len(part) > 32:
                    value = value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                yield rows, (value.astype(np.int64) + (index << 33)) & ((1 << 37) - 1), d > 0


def near(prints: DataFrame, distance: int, sample: int = SAMPLE, block: int = 2048) -> DataFrame:
    """Links (a, b) between representatives of fingerprints at most ``distance`` bits apart, from (rep, fp) with
    distinct fp: a forest of each bucket's links, which has the components of all links.

    A bucket that more rows than ``block`` (and than 1/4096 of all) share is dealt into tiles, see pairs.py.
    """
    spark = prints.sparkSession
    rows = prints.count()
    chosen = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").toArrow().column("fp").to_numpy()
    plan = choose(chosen.view(np.uint64), rows, distance)
    schema = "tile long, kind int, fp long, rep long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            for _, key, probe in bucket_keys(fps, plan):
                if not probe:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    least = max(block, rows // 4096)
    # only a part whose values are far from even can have a bucket as large as that
    hot = hot_keys(prints.select("rep", "fp").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")), least)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, signed = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = signed.view(np.uint64)
            spot = fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            for _, key, probe in bucket_keys(fps, plan):
                row, tile, kind, _ = deal(key, np.full(len(key), probe), spot, hot)
                for k in range(0, len(row), 100_000):
                    at = row[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(tile[k : k + 100_000]), pa.array(kind[k : k + 100_000].astype(np.int32)), pa.array(signed[at]), pa.array(reps[at])], names=["tile", "kind", "fp", "rep"])

    def links(table: pa.Table, starts: np.ndarray, kind: np.ndarray, again: bool) -> Iterator[pa.RecordBatch]:
        fps, reps = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        found_a, found_b = [], []
        size = np.diff(starts)
        # small tiles side by side: each row with the one d rows on
        small = np.repeat(size <= 64, size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, min(64, int(size[size <= 64].max(initial=1)))):
            at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & (kind[:-d] == LEFT) & (np.bitwise_count(fps[:-d] ^ fps[d:]) <= distance))
            found_a.append(at)
            found_b.append(at + d)
        for k in np.flatnonzero(size > 64):
            lo, hi = starts[k], starts[k + 1]
            left = lo + int(np.searchsorted(kind[lo:hi], LEFT, side="right"))
            mixed = kind[hi - 1] == RIGHT
            for x in range(lo, left, 512):
                for y in range(left if mixed else x, hi, 4096):
                    top, end = min(x + 512, left), min(y + 4096, hi)
                    i, j = np.nonzero(np.bitwise_count(fps[x:top, None] ^ fps[None, y:end]) <= distance)
                    ok = i + x < j + y
                    if ok.any():
                        a, b = forest(i[ok] + x, j[ok] + y)
                        found_a.append(a)
                        found_b.append(b)
        a, b = np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])
        if len(a):
            a, b = forest(reps[a], reps[b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return compare(prints.select("rep", "fp").mapInArrow(spread, schema), links, "a long, b long", partitions(spark))


def simhash_groups(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    fingerprint: 16 hex digits; component_id: the smallest doc_id that links between fingerprints at most
    ``distance`` bits apart reach, itself included. Texts that are null, empty or without words have fingerprint
    zero and link like others. Rows with a null doc_id have a fingerprint, link nothing and a null component_id;
    repeated rows are given back repeated. Extra columns aren't read; an empty table gives no rows.

    The text is read once and not shuffled; classes of equal fingerprints are counted before a shuffle, and only
    their representatives are compared.
    """
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    classes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    grouped = components(near(classes, distance))
    found = classes.join(grouped, classes["rep"] == grouped["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(found, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group (or null); columns as they were."""
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
