"""Substring dedup: windows of words that recur in other documents, found by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import partitions, words

#: Words of the pieces whose smallest hash is a window's minimiser.
PIECE = 3
#: Bytes of text of a chunk of documents, at most (but for a single document).
CHUNK = 8 << 20
#: Bytes of packed strings that a bucket is meant to get, at most.
BUCKET = 12 << 20
#: Chunks, and buckets, that a task is meant to get.
GROUPS = 4
#: One in so many documents tells which minimisers are hot. It decides where windows are compared, not what is found.
SHARE = 64


class Packed(NamedTuple):
    """The words of some documents, and their super-k-mers: runs of windows of one document with one minimiser."""

    words: list[bytes]
    sizes: np.ndarray  # words of each document
    buffer: bytes  # all words, with a space after each
    offsets: np.ndarray  # where each word begins in it
    starts: np.ndarray  # the first word of each super-k-mer
    counts: np.ndarray  # its windows
    routes: np.ndarray  # its minimiser; windows of a hot minimiser travel one by one, by their own hash
    owner: np.ndarray  # the document of each super-k-mer

    def strings(self, width: int) -> list[bytes]:
        ends = self.offsets[self.starts + self.counts + width - 1] - 1
        buffer = self.buffer
        return [buffer[a:b] for a, b in zip(self.offsets[self.starts].tolist(), ends.tolist())]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


#: A number for each byte at each of 64 places within a word; words are hashed by their sums (tabulation).
TABLE = mixed(mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20


def word_hashes(buffer: bytes, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word of a buffer, from where they begin. It decides where windows meet, not which are equal."""
    data, n = np.frombuffer(buffer, np.uint8), len(offsets) - 1
    out, a = np.empty(n, np.uint64), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SEGMENT)) - 1)
        start, end = int(offsets[a]), int(offsets[b])
        place = np.arange(start, end) - np.repeat(offsets[a:b], np.diff(offsets[a : b + 1]))
        out[a:b] = np.add.reduceat(TABLE[(place & 63) << 8 | data[start:end]], offsets[a:b] - start)
        a = b
    return out


def pack(texts: list[str | None], width: int, hot: np.ndarray) -> Packed:
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    n = len(flat)
    buffer = b" ".join(flat) + b" "
    offsets = np.append(0, np.cumsum(np.fromiter(map(len, flat), np.int64, n) + 1))
    empty = np.zeros(0, np.int64)
    if n < width:
        return Packed(flat, sizes, buffer, offsets, empty, empty, empty.view(np.uint64), empty)
    h = word_hashes(buffer, offsets)
    low = h[: n - PIECE + 1].copy()
    for k in range(1, PIECE):
        low = low * np.uint64(0xD6E8FEB86659FD93) + h[k : n - PIECE + 1 + k]
    low = mixed(low)
    # the smallest of the window's pieces, by doubling
    need, have = width - PIECE + 1, 1
    while 2 * have <= need:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < need:
        low = np.minimum(low[: have - need], low[need - have :])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[: n - width + 1] == owner[width - 1 :]
    new = np.append(True, (low[1:] != low[:-1]) | (owner[1 : n - width + 1] != owner[: n - width]) | ~whole[:-1])
    starts = np.flatnonzero(new & whole)
    ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True)) + 1
    counts, routes = ends - starts, low[starts]
    single = np.isin(routes, hot)
    if single.any():
        copies = np.where(single, counts, 1)
        at = np.repeat(np.arange(len(starts)), copies)
        starts = starts[at] + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        counts, routes, single = np.where(single, 1, counts)[at], routes[at], single[at]
        roll = np.zeros(single.sum(), np.uint64)
        for k in range(width):
            roll = roll * np.uint64(0xD6E8FEB86659FD93) + h[starts[single] + k]
        routes[single] = mixed(roll)
    return Packed(flat, sizes, buffer, offsets, starts, counts, routes, owner[starts])


def press(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))


def unpress(blob: bytes, parts: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * parts
    for size in np.frombuffer(data[:at], "<i8").tolist():
        out.append(data[at : at + size])
        at += size
    return out


def hot_minimisers(rows: DataFrame, width: int) -> np.ndarray:
    """The minimisers whose distinct super-k-mers are over a bucket's worth of bytes, by what one in SHARE documents
    holds. There are at most as many as buckets."""
    schema = "route long, string long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pack(batch.column(0).to_pylist(), width, np.zeros(0, np.uint64))
            strings = found.strings(width)
            digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
            _, at = np.unique(digests, return_index=True)
            size = np.fromiter(map(len, strings), np.int64, len(strings))
            yield pa.RecordBatch.from_arrays([pa.array(found.routes[at].view(np.int64)), pa.array(digests[at].view(np.int64)), pa.array(size[at])], names=["route", "string", "bytes"])

    some = rows.where("doc_id is not null and text is not null").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARE)) == 0)
    distinct = some.select("text").mapInArrow(run, schema).groupBy("route", "string").agg(F.first("bytes").alias("bytes"))
    large = distinct.groupBy("route").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") * SHARE > BUCKET)
    return np.sort(np.array([r.route for r in large.collect()], np.int64).view(np.uint64))


def send(table: pa.Table, width: int, buckets: int, hot: np.ndarray) -> pa.Table:
    """(bucket, chunk, blob) from a chunk's (chunk, doc_id, text): for each bucket the distinct super-k-mers, each
    with the smallest and the largest doc_id that has it."""
    table = table.filter(table.column("doc_id").is_valid())
    docs, found = table.column("doc_id").to_numpy(), pack(table.column("text").to_pylist(), width, hot)
    first: dict[bytes, int] = {}
    strings = found.strings(width)
    at = np.fromiter((first.setdefault(s, k) for k, s in enumerate(strings)), np.int64, len(strings))
    own = docs[found.owner] if len(strings) else np.zeros(0, np.int64)
    least, most = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
    np.minimum.at(least, at, own)
    np.maximum.at(most, at, own)
    kept = np.fromiter(first.values(), np.int64, len(first))
    bucket = (found.routes[kept] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = kept[order], bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    tags = (found.routes >> np.uint64(32)).astype(np.uint32)
    blobs = [press(least[kept[a:b]], most[kept[a:b]], tags[kept[a:b]], b"\n".join(strings[k] for k in kept[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:])]
    chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
    return pa.table({"bucket": pa.array(bucket[cuts[:-1]], pa.int64()), "chunk": pa.array([chunk] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def judge(table: pa.Table, width: int) -> pa.Table:
    """(chunk, blob) from a bucket's (bucket, chunk, blob): for each chunk the super-k-mers, by their digests, of which
    a smaller doc_id has a window, with the smallest doc_id of each of their windows."""
    least, most, tags, chunk, strings = [], [], [], [], []
    for home, blob in zip(table.column("chunk").to_pylist(), table.column("blob")):
        a, b, c, joined = unpress(blob.as_py(), 4)
        for column, x in zip((least, most, tags, chunk), (np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.uint32), np.full(len(a) // 8, home))):
            column.append(x)
        strings += joined.split(b"\n")
    least, most, tags, chunk = (np.concatenate(x) for x in (least, most, tags, chunk))
    # equal windows have one route: where a route is in one string of one document, there is nothing to compare
    _, which, often = np.unique(tags, return_inverse=True, return_counts=True)
    kept = np.flatnonzero((often[which] > 1) | (least < most))
    if not len(kept):
        return pa.table({"chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    least, most, chunk = least[kept], most[kept], chunk[kept]
    place: dict[bytes, int] = {}
    at = np.fromiter((place.setdefault(strings[k], len(place)) for k in kept.tolist()), np.int64, len(kept))
    strings = list(place)
    own = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(own, at, least)
    flat = b" ".join(strings).split(b" ")
    sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    h = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[ids]
    n = len(flat) - width + 1
    roll = h[:n].copy()
    for k in range(1, width):
        roll = roll * np.uint64(0xD6E8FEB86659FD93) + h[k : n + k]
    ends = np.cumsum(sizes)
    counts = sizes - width + 1
    first = np.cumsum(counts) - counts
    windows = np.repeat(ends - sizes - first, counts) + np.arange(counts.sum())
    holder = np.repeat(np.arange(len(strings)), counts)
    order = np.argsort(roll[windows], kind="stable")
    there = windows[order]
    same = roll[there[1:]] == roll[there[:-1]]
    equal = same.copy()
    for k in range(width):
        equal &= ids[there[1:] + k] == ids[there[:-1] + k]
    if (equal != same).any():  # two sequences with one hash: sort by the words themselves
        order = np.lexsort([ids[windows + k] for k in range(width)])
        there = windows[order]
        equal = np.ones(len(there) - 1, bool)
        for k in range(width):
            equal &= ids[there[1:] + k] == ids[there[:-1] + k]
    runs = np.flatnonzero(np.append(True, ~equal))
    smallest = np.repeat(np.minimum.reduceat(own[holder[order]], runs), np.diff(np.append(runs, len(order))))
    owners = np.empty(len(order), np.int64)
    owners[order] = smallest
    lowest = np.minimum.reduceat(owners, first)
    told = np.flatnonzero(lowest[at] < most)
    told = told[np.argsort(chunk[told], kind="stable")]
    homes, blobs = [], []
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(chunk[told]) != 0)), len(told)) if len(told) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = at[told[a:b]]
        homes.append(int(chunk[told[a]]))
        blobs.append(press(b"".join(xxhash.xxh3_128_digest(strings[k]) for k in mine.tolist()), counts[mine], np.concatenate([owners[first[k] : first[k] + counts[k]] for k in mine.tolist()])))
    return pa.table({"chunk": pa.array(homes, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def erase(docs: pa.Table, told: pa.Table, width: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Each document's words, words removed, and the text of those kept."""
    texts = docs.column("text").to_pylist()
    found = pack(texts, width, hot)
    owners: dict[bytes, np.ndarray] = {}
    for blob in told.column("blob"):
        digests, counts, values = unpress(blob.as_py(), 3)
        ends, values = np.cumsum(np.frombuffer(counts, np.int64)), np.frombuffer(values, np.int64)
        for k, part in enumerate(np.split(values, ends[:-1])):
            owners[digests[16 * k : 16 * k + 16]] = part
    change = np.zeros(len(found.words) + 1, np.int64)
    if owners:
        where, values, ids = [], [], []
        doc = docs.column("doc_id").to_pylist()
        digest, get = xxhash.xxh3_128_digest, owners.get
        for s, start, k in zip(found.strings(width), found.starts.tolist(), found.owner.tolist()):
            part = get(digest(s))
            if part is not None and doc[k] is not None:
                where.append(start)
                values.append(part)
                ids.append(doc[k])
        if where:
            size = np.array([len(v) for v in values])
            gone = np.concatenate(values) < np.repeat(ids, size)
            at = (np.repeat(np.array(where) - (np.cumsum(size) - size), size) + np.arange(size.sum()))[gone]
            np.add.at(change, at, 1)
            np.add.at(change, at + width, -1)
    covered = np.cumsum(change)[:-1] > 0
    ends = np.cumsum(found.sizes)
    total = np.append(0, np.cumsum(covered))
    removed = total[ends] - total[ends - found.sizes]
    kept: list[str | None] = []
    for text, end, size, n in zip(texts, ends.tolist(), found.sizes.tolist(), removed.tolist()):
        own = found.words[end - size : end]
        if n:
            own = [own[k] for k in np.flatnonzero(~covered[end - size : end]).tolist()]
        kept.append(None if text is None else b" ".join(own).decode("utf-8", "replace"))
    return found.sizes, removed, kept


def substring_dedup(docs: DataFrame, width: int = 13, piece_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row.

    Words are runs of other characters than space and \\t to \\r. A window is ``width`` consecutive words of one
    document; each word that a window covers whose words also are a window of a document with a smaller doc_id is
    removed. Windows are those of the input. kept: the words left, joined by one space (null for a null text, which
    has no words). Rows that repeat a doc_id don't remove each other's words; a null doc_id neither removes nor
    loses words. Extra columns aren't read; an empty table gives no rows.

    Documents are dealt into chunks of bounded size; each sends its distinct super-k-mers once to their minimisers'
    buckets, however many of its documents have them, and gets back the smallest doc_id of those windows that an
    earlier document has. So a passage that a third of all documents share takes a bucket a string for each chunk,
    not for each document. The windows of a hot minimiser (a frequent piece in ever new company) are dealt one by one,
    by their own hash. Rows alike in doc_id and text are counted where they meet, and are one row in a chunk.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    tasks = partitions(spark)
    chunks, buckets = max(2 * tasks, -(-size // piece_bytes)), max(tasks, -(-3 * size // BUCKET))
    # tasks of a few chunks and buckets each, so that they don't grow with the input
    at_chunks, at_buckets = max(tasks, -(-chunks // GROUPS)), max(tasks, -(-buckets // GROUPS))
    hot = hot_minimisers(rows, width)
    # dealt by chunk alone, which serves the count, both groupings and the way back: texts are shuffled once
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(at_chunks, "chunk").groupBy("chunk", "doc_id", "text").agg(F.count("*").alias("copies"))
    sent = rows.groupBy("chunk").applyInArrow(lambda table: send(table, width, buckets, hot), "bucket long, chunk long, blob binary")
    told = sent.repartition(at_buckets, "bucket").groupBy("bucket").applyInArrow(lambda table: judge(table, width), "chunk long, blob binary")
    schema = "doc_id long, n_words long, n_removed long, kept string, copies long"

    def finish(own: pa.Table, news: pa.Table) -> pa.Table:
        sizes, removed, kept = erase(own, news, width, hot)
        return pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(sizes), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.string()), "copies": own.column("copies")})

    found = rows.groupBy("chunk").cogroup(told.repartition(at_chunks, "chunk").groupBy("chunk")).applyInArrow(finish, schema)
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
