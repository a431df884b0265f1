"""Source divergence audit: how far the term frequencies of a language's sources lie from each other and from the language.

A first read builds count-min sketches of document frequencies, merged block by block: they never underestimate, so a
term whose cells stay below the least frequency can't be kept, and leaves before anything is shuffled. A second read
counts the others exactly. Pairs of sources are compared by joining the terms that both have; what a pair's other terms
add follows from each source alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut, partitions

#: Rows of a sketch, each with a hash of its own, and odd numbers that make them of one hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
#: Cells of a sketch's row for each document, and their bounds as powers of two. Few cells only let more terms through.
CELLS, FEWEST, MOST = 8, 16, 26
#: Cells that are merged together.
BLOCK = 1 << 14
#: Bytes of text that are worked on together, at most (but for a longer text).
SLICE = 1 << 23
#: What a byte becomes: a-z for A-Z and itself, other bytes of terms themselves, a blank for all that parts terms.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


class Terms(NamedTuple):
    """The terms of some texts: the text that each occurrence is in, its number among the different ones, and these."""

    text: np.ndarray
    number: np.ndarray
    known: list[bytes]


def terms(texts: pa.Array) -> Terms:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of whole texts in UTF-8, A-Z in lower case."""
    if not len(texts):
        return Terms(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(FOLDED[data]))
    lists = pc.ascii_split_whitespace(folded)
    words = lists.flatten()
    there = pc.not_equal(words, "")
    coded = words.filter(there).dictionary_encode()
    text = pc.list_parent_indices(lists).filter(there)
    return Terms(text.to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist())


def slices(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about SLICE bytes of text each, or one text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(texts)).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def numbered(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def distinct(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, in order, and how often each occurs. low is under width."""
    both, times = np.unique(high * max(1, width) + low, return_counts=True)
    return both // max(1, width), both % max(1, width), times


def cells(lang: np.ndarray, langs: list[bytes], words: list[bytes], bits: int) -> np.ndarray:
    """The cell of each word of a language in each row of a sketch with 2**bits cells a row. lang: each word's, by number."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = (h ^ np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in langs), np.uint64, len(langs))[lang]) if len(words) else h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h[None, :] * ODD[:, None]) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """A count-min sketch whose cells stop at 255."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros((len(ODD), 1 << bits), np.uint8)

    def add(self, at: np.ndarray, number: np.ndarray) -> None:
        """Adds numbers to cells; at: see cells()."""
        for row, own in zip(self.table, at):
            where, group = np.unique(own, return_inverse=True)
            row[where] = np.minimum(255, row[where] + np.bincount(group, weights=number).astype(np.int64))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(place, cells) of the blocks that hold anything."""
        flat = self.table.reshape(-1, min(BLOCK, 1 << self.bits))
        for k in np.flatnonzero(flat.any(1)).tolist():
            yield k, flat[k].tobytes()


def columns(docs: DataFrame) -> DataFrame:
    """(lang, source, text) in UTF-8, each '' for null."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")))


def possible_terms(docs: DataFrame, least: int, bits: int | None = None) -> np.ndarray:
    """A bit for each cell of the merged sketches: whether it reached ``least``. One read of lang and text; tasks shuffle the
    blocks of their sketches; the driver gets the bits, 24 MB at most. Beyond the most cells more terms share one and get
    through, to be counted exactly."""
    if bits is None:
        bits = int(np.clip(int(CELLS * max(1, docs.count())).bit_length(), FEWEST, MOST))
    floor = min(least, 255)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(bits)
        for batch in slices(batches, 1):
            lang, langs = numbered(batch.column(0))
            found = terms(batch.column(1))
            text, number, _ = distinct(found.text, found.number, len(found.known))
            of, number, df = distinct(lang[text], number, len(found.known))
            own.add(cells(of, langs, [found.known[k] for k in number.tolist()], bits), df)
        for k, block in own.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.binary())], names=["place", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(block.as_buffer(), np.uint8)
                sums[k] = np.minimum(255, sums[k].astype(np.uint16) + new).astype(np.uint8) if k in sums else new.copy()
        for k, block in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(block >= floor).tobytes()], pa.binary())], names=["place", "bits"])

    parts = columns(docs).select("lang", "text").mapInArrow(sketch, "place int, cells binary")
    merged = parts.repartition(partitions(docs.sparkSession), "place").mapInArrow(merge, "place int, bits binary")
    found = np.zeros((len(ODD) << bits) // 8, np.uint8)
    block = min(BLOCK, 1 << bits) // 8
    for r in merged.collect():
        found[r.place * block : (r.place + 1) * block] = np.frombuffer(r.bits, np.uint8)
    return found.reshape(len(ODD), -1)


def exact_counts(docs: DataFrame, possible: np.ndarray, least: int) -> DataFrame:
    """(lang, source, term, n, all): how often each group has each term that is kept, and its language; and a row with the
    term '' for each group, so that one without terms is known too.

    A task passes on a row for each possible term of a slice of texts, with the sources that have it. These meet by
    language and term, where they are summed and what isn't kept leaves; no other shuffle follows.
    """
    spark, bits = docs.sparkSession, int(possible.shape[1] * 8).bit_length() - 1
    sent = spark.sparkContext.broadcast(possible)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches, 2):
            lang, langs = numbered(batch.column(0))
            source, sources = numbered(batch.column(1))
            found = terms(batch.column(2))
            width = len(found.known)
            text, number, _ = distinct(found.text, found.number, width)
            of, number, df = distinct(lang[text], number, width)
            at = cells(of, langs, [found.known[k] for k in number.tolist()], bits)
            there = np.logical_and.reduce([(row[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 for row, c in zip(table, at)]).astype(bool)
            place = np.full(len(langs) * width, -1)
            place[of[there] * width + number[there]] = np.arange(there.sum())
            mine = place[lang[found.text] * width + found.number]
            mine, by, n = distinct(mine[mine >= 0], source[found.text[mine >= 0]], len(sources))
            groups_lang, groups_source, _ = distinct(lang, source, len(sources))
            # terms first, then a row for each language with its sources
            of, number, df = of[there], number[there], np.append(df[there], np.zeros(len(langs), np.int64))
            sizes = np.append(np.bincount(mine, minlength=len(of)), np.bincount(groups_lang, minlength=len(langs)))
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            whose = np.append(by, groups_source)
            n = np.append(n, np.zeros(len(groups_source), np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.binary()).take(pa.array(np.append(of, np.arange(len(langs))))), pa.array([*found.known, b""], pa.binary()).take(pa.array(np.append(number, np.full(len(langs), width)))), pa.array(df),
                    pa.ListArray.from_arrays(ends, pa.array(sources, pa.binary()).take(pa.array(whose))), pa.ListArray.from_arrays(ends, pa.array(n)),
                ],
                names=["lang", "term", "df", "sources", "ns"],
            )

    packed = columns(docs).mapInArrow(count, "lang binary, term binary, df long, sources array<binary>, ns array<long>").repartition("lang", "term")
    each = packed.select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "ns")).alias("at", "x"))
    # a row's documents count once, with its first source
    each = each.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.ns").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("df"))).alias("df"))
    whole = Window.partitionBy("lang", "term")
    told = each.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("all"), F.sum("df").over(whole).alias("df"))
    return told.where((F.col("df") >= least) | (F.col("term") == F.lit(b""))).select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "all")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exactly, whatever the counts."""
    return F.expr(f"1 + (1000000000 * (CAST({count} AS DECIMAL(20, 0)) + 2)) div CAST(CAST({total} AS DECIMAL(20, 0)) + 2 * {kept} AS DECIMAL(21, 0))")


def apart(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q)), in SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergence(docs: DataFrame, least: int = 10, top: int = 10, bits: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs.

    A language keeps the terms in at least ``least`` of its rows. p of a term in a group or a language is its smoothed
    share in 10**9, and f = (p - q)**2 / (p + q) rounded down. Part ``pair``: each other source of the language, with
    the sum of f over all kept terms; part ``term``: the group's ``top`` terms that it has more of than the language.
    Ranks go by descending value, then by the item's UTF-8.

    Null text, lang and source count as ''. A group without terms has its pairs too; a language without kept terms has
    pairs of value 0 and no terms; a source that is alone has no pairs. Rows count each, whatever their doc_id, and
    doc_id isn't read; nor are extra columns. An empty table gives no rows. bits: cells of a sketch's row as a power of
    two; by default they follow the number of rows. Results don't depend on it.

    A task holds the terms of a slice of texts, its sketch and the bits of the possible terms. A pair
    of sources meets once for each term that both have, and is summed where it meets: the result itself has a row for
    each pair.
    """
    counts = cut(exact_counts(docs, possible_terms(docs, least, bits), least))
    held = counts.where("term <> ''")
    langs = held.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    kept = held.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("v"))
    langs = langs.join(kept, "lang")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "own", "v", "lang_total")))
    # base: p of a term that the group hasn't got
    groups = cut(groups.withColumn("base", F.when(F.col("v") > 0, share("0", "total", "v"))))
    shares = cut(held.join(groups, ["lang", "source"]).select("lang", "source", "term", "base", share("n", "total", "v").alias("p"), share("all", "lang_total", "v").alias("q")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    of_terms = of_terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    one, two = shares.alias("a"), shares.alias("b")
    met = f"{apart('a.p', 'b.p')} - {apart('a.p', 'b.base')} - {apart('a.base', 'b.p')} + {apart('a.base', 'b.base')}"
    both = one.join(two, F.expr("a.lang = b.lang AND a.term = b.term AND a.source < b.source")).select("a.lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.expr(met).alias("met"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("met").alias("met"))
    # a group's own terms against what another has of a term that it hasn't got; equal shares are taken together
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    against = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    alone = levels.join(against, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"times * {apart('p', 'other')}")).alias("alone"))
    alone = alone.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "alone").groupBy("lang", "source", "item").agg(F.sum("alone").alias("alone"))
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, F.expr("a.lang = b.lang AND a.source < b.source")).select(
        "a.lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.expr(f"(a.v - a.own - b.own) * {apart('a.base', 'b.base')}").alias("rest")
    )
    value = F.coalesce("rest", zero) + F.coalesce("alone", zero) + F.coalesce("met", zero)
    pairs = pairs.join(alone, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value"))
    pairs = pairs.union(pairs.select("lang", F.col("item"), F.col("source"), "value"))
    of_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return of_pairs.union(of_terms)
