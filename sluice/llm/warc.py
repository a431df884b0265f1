"""WARC: a deterministic sharded writer of web archives, and a reader, as Spark data sources."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sluice.llm.shared import cut, partitions

MANIFEST = "_manifest.json"
TEMPORARY = "_temporary"
#: Files that get their names at a time when a write commits.
MOVES = 16
#: Bytes of payloads that a shard is meant to get, at most, where the number of shards isn't given.
SHARD = 1 << 28
#: Compressed bytes after which a shard goes on in a new file.
ROLL = 64 << 20
LEVEL = 4
#: Payloads of fewer bytes are always written in full.
SHORT = 1000
FIELDS = "page_id long, url string, html string, payload_digest string, refers_to long, known_digest string"


def record_id(page_id: int | None, digest: str) -> str:
    """A UUID of version 8 that holds the page's id, whether it is null, and 57 bits of the payload's digest."""
    n = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    low = (n & 0xF) << 58 | (page_id is None) << 57 | int(digest[:15], 16) >> 3
    return str(uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | low))


def page_of(record: str) -> int | None:
    x = uuid.UUID(record).int
    n = (x >> 80) << 16 | (x >> 64 & 0xFFF) << 4 | (x >> 58 & 0xF)
    return None if x >> 57 & 1 else n - (1 << 64 if n >> 63 else 0)


def as_warc_digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own; its length and block digest are made here."""
    fields = {"WARC-Type": kind, **headers, "WARC-Block-Digest": as_warc_digest(hashlib.sha1(block).hexdigest()), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of the page refers_to: the HTTP headers alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": f"<urn:uuid:{record_id(page_id, digest)}>", "WARC-Date": date, "WARC-Payload-Digest": as_warc_digest(digest), "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if refers_to is None:
        return record("response", headers, http + payload)
    headers |= {"WARC-Refers-To": f"<urn:uuid:{record_id(refers_to, digest)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", headers, http)


def records(stream, size: int = 1 << 20, bite: int = 1 << 14) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a file, read ``size`` bytes at a time and unpacked in small bites."""
    data, at = stream.read(size), 0
    while data:
        unpress, parts = zlib.decompressobj(31), []
        while not unpress.eof:
            if at == len(data):
                data, at = stream.read(size), 0
                if not data:
                    raise ValueError("the archive ends within a record")
            piece = data[at : at + bite]
            parts.append(unpress.decompress(piece))
            at += len(piece) - len(unpress.unused_data)
        if at == len(data):
            data, at = stream.read(size), 0
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or as_warc_digest(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
            raise ValueError("a record doesn't match its headers")
        yield fields, block


@dataclass
class Written(WriterCommitMessage):
    """A task's files: (temporary name, name, records, bytes, sha256)."""

    files: list[tuple[str, str, int, int, str]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under temporary names; the commit renames those of the tasks that count, and then makes
    the manifest appear, also by a rename. A lost or repeated task leaves nothing that a reader takes."""

    def __init__(self, options: dict[str, str]):
        self.path, self.roll, self.date = options["path"], int(options.get("roll", ROLL)), options.get("date", "1970-01-01T00:00:00Z")
        self.drafts = f"{TEMPORARY}-{uuid.uuid4().hex}"  # of this write alone

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = fs.FileSystem.from_uri(self.path)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(f"{top}/{self.drafts}")
        done: list[tuple[str, str, int, int, str]] = []
        out, told = None, {}

        def close() -> None:
            out.close()
            done.append((temporary, name, count, size, check.hexdigest()))

        for batch in iterator:
            for page, url, html, digest, refers, known in zip(*(c.to_pylist() for c in batch.columns)):
                if known is not None:  # stands before the pages that it is about
                    if page not in told:
                        told = {page: {}}
                    told[page][known] = refers
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = page_record(page, url, payload, digest, told.get(page, {}).get(digest), self.date)
                if out is None:
                    name = f"part-{shard:05d}-{len(done):05d}.warc.gz"
                    temporary, count, size, check = f"{self.drafts}/{attempt}-{name}", 0, 0, hashlib.sha256()
                    out = store.open_output_stream(f"{top}/{temporary}", compression=None)
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": self.date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    check.update(info)
                    size += len(info)
                out.write(data)
                check.update(data)
                count, size = count + 1, size + len(data)
                if size >= self.roll:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(top)
        if store.get_file_info(f"{top}/{MANIFEST}").type == fs.FileType.File:
            raise FileExistsError(f"{self.path} has an archive already; write to a path of its own")
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: store.move(f"{top}/{f[0]}", f"{top}/{f[1]}"), files))
        with store.open_output_stream(f"{top}/{MANIFEST}.tmp", compression=None) as out:
            out.write(json.dumps([{"name": name, "records": n, "bytes": size, "sha256": check} for _, name, n, size, check in files]).encode())
        store.move(f"{top}/{MANIFEST}.tmp", f"{top}/{MANIFEST}")
        if store.get_file_info(f"{top}/{self.drafts}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.drafts}")

    def abort(self, messages: list[Written | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for temporary, *_ in m.files if m else []:
                if store.get_file_info(f"{top}/{temporary}").type == fs.FileType.File:
                    store.delete_file(f"{top}/{temporary}")


class Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class WarcReader(DataSourceReader):
    """A task for each file of the manifest. Lengths and digests are those of the payloads as read, for revisits
    those that the record states."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        store, top = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{top}/{MANIFEST}", compression=None) as f:
            return [Archive(x["name"]) for x in json.loads(f.read())] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.name:
            return
        store, top = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{top}/{partition.name}", compression=None) as stream:
            for fields, block in records(stream):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                length = int(http.partition(b"Content-Length: ")[2].split(b"\r\n")[0])
                refers = fields.get("WARC-Refers-To")
                if refers is None and (len(payload) != length or hashlib.sha1(payload).hexdigest() != stated):
                    raise ValueError("a payload doesn't match its headers")
                yield page_of(fields["WARC-Record-ID"][10:-1]), fields.get("WARC-Target-URI"), length, stated, fields["WARC-Type"], page_of(refers[10:-1]) if refers else None, partition.name


class Warc(DataSource):
    """spark.write/read.format("warc") with the options path, roll and date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def range_ends(sized: DataFrame, shards: int) -> list[int]:
    """The largest page_id of each shard but the last, from (page_id, size), so that shards get about as many bytes each;
    an id that holds over a shard's worth stands there for as many shards, which its rows are dealt to.

    Sums of bytes by leading bits of the id, finer where a group holds over a shard's worth; they don't depend on
    the order in which tasks end, so a second run has the same shards. At most 1024 groups a shard reach the driver.
    """
    sized = sized.where("page_id is not null")
    span = sized.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum("size").alias("size")).first()
    if shards < 2 or span.size is None:
        return []
    step = max(0, (span.high - span.low).bit_length() - 10)
    share = -(-span.size // shards)
    weights: dict[tuple[int, int], int] = {}  # by a group's leading bits, and how many bits follow
    inside = sized
    while True:
        found = {(r.lead, step): r.size for r in inside.groupBy(F.shiftright("page_id", step).alias("lead")).agg(F.sum("size").alias("size")).collect()}
        heavy = sorted(k for k, size in found.items() if size > share and step > 0)
        weights |= {k: v for k, v in found.items() if k not in set(heavy)}
        if not heavy:
            break
        few = sized.sparkSession.createDataFrame([(lead,) for lead, _ in heavy], "lead long")
        inside = sized.join(F.broadcast(few), F.shiftright("page_id", step) == F.col("lead"), "left_semi")
        step = max(0, step - 10)
    ends, total = [], 0
    for (lead, bits), size in sorted(weights.items(), key=lambda x: x[0][0] << x[0][1]):
        if total + size > share * (len(ends) + 1) and len(ends) < shards - 1 and total:
            ends.append((lead << bits) - 1)
        total += size
        if bits == 0:
            ends += [lead] * min(size // share - 1, shards - 1 - len(ends))
    return ends


def write_archives(pages: DataFrame, path: str, shards: int | None = None, roll: int = ROLL, short: int = SHORT) -> None:
    """Writes a record for every row of pages (page_id, url, html) below path, in the order of page_id.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least ``short`` bytes the
    one with the largest page_id is the response, the others revisit it; smaller ones are all responses. A row with a
    null page_id is a response; rows that repeat a page_id and its payload are alike. A null url has no target
    header; control characters in one are percent-encoded. Extra columns aren't read; an empty table gives an empty
    manifest.

    Payloads are shuffled once, by ranges of page_id; the digests of equal ones are joined without them, and rows with a
    null page_id are dealt by digest. There are as many shards as shuffle partitions, or more so that each gets about
    SHARD bytes. The table is read twice: for sizes and digests, and for the payloads. Files are
    the same bytes for the same rows and ``shards``. A path that holds an archive is refused, so none is ever replaced.
    """
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))))
    length = F.coalesce(F.octet_length("html"), F.lit(0))
    sized = cut(rows.select("page_id", (length + 512).cast("long").alias("size"), (length >= short).alias("long"), "payload_digest"))
    keys = sized.where(F.col("long") & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    response = keys.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least <> refers_to")
    revisits = keys.join(response, "payload_digest").where("page_id <> refers_to").distinct()
    none = F.lit(None).cast("string")
    both = rows.select("page_id", "url", "html", "payload_digest", F.lit(None).cast("long").alias("refers_to"), none.alias("known_digest")).union(
        revisits.select("page_id", none, none, none, "refers_to", "payload_digest")
    )
    if not shards:
        shards = max(partitions(spark), -(-(sized.agg(F.sum("size").alias("n")).first().n or 0) // SHARD))
    ends = range_ends(sized, shards)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, spot: pd.Series) -> pd.Series:
        of = np.array(ends, np.int64)
        known, ids = page_id.notna().to_numpy(), page_id.fillna(0).astype("int64")
        low = np.where(known, np.searchsorted(of, ids), 0)
        high = np.where(known, np.searchsorted(of, ids, side="right"), len(of))
        # rows of an id that is an end go to its shard or those after, in order with the ids around it either way
        return pd.Series((low + spot.to_numpy() % (high - low + 1)).astype("int32"))

    spot = F.pmod(F.xxhash64(F.coalesce("known_digest", "payload_digest")), F.lit(1 << 31))
    dealt = both.repartitionById(len(ends) + 1, shard("page_id", spot)).sortWithinPartitions("page_id", F.col("known_digest").isNull(), "known_digest", "payload_digest", "url")
    dealt.write.format("warc").mode("append").option("path", path).option("roll", str(roll)).save()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, file) of every record that the manifest's files
    hold, a row for each, whatever repeats; an empty manifest gives no rows, a path without one fails, and so does a record
    whose length or digests aren't as its headers say. page_id and url are null where they were."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", path).load()
