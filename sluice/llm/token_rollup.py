"""Token counts: rollups by source, language and tokenizer version, maintained from signed deltas."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.storage import places, take_place

KEYS = ["source", "lang", "version"]
MEASURES = ["n_docs", "n_tokens"]
RECORD = "doc_id long, version string, present boolean, source string, lang string, n_tokens long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long, batch string"
#: Folders that a batch's records are dealt into by doc_id; a commit reads those that its documents are in.
BUCKETS = 64
#: A commit of up to so many documents looks them up by doc_id within the buckets, which are sorted by it.
FEW = 1000
#: Batches after which a commit folds all into one.
FOLD = 24


class TokenLedger:
    """Token counts of documents, and their totals, in a folder of Parquet that batches are committed to.

    ``record/<batch>`` holds what a batch says of each of its documents, dealt into buckets by doc_id; ``delta/<batch>``
    what it adds to the totals, with a sign; ``log/<place>.json`` appears last, as a whole and by one writer alone (see
    storage.take_place), and gives the batch's place in the order. A document's newest record counts. Only logged batches
    count, so one that a lost driver left half done is written anew, and one that was committed changes nothing when it
    comes again. A commit reads the buckets of its own documents (of a small one only the row groups that may have them)
    and writes its own records; every FOLD batches all are folded into one, in a folder with a name of its own, so that
    two that fold at a time don't touch each other's.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> tuple[int, list[dict]]:
        """The next free place, and the committed batches in order, from the last fold on; a few bytes for each batch."""
        names = places(self.spark, f"{self.path}/log")
        if not names:
            return 0, []
        schema = "place long, batch string, folded array<string>"
        rows = self.spark.read.schema(schema).json([f"{self.path}/log/{n}" for n in names]).where("batch is not null").collect()
        log = sorted((r.asDict() for r in rows), key=lambda r: r["place"])
        last = max((k for k, r in enumerate(log) if r["folded"] is not None), default=0)
        return int(names[-1].split(".")[0]) + 1, log[last:]

    def _enter(self, place: int, batch: str, folded: list[str] | None = None) -> bool:
        """Takes a place in the log; False if another writer took it."""
        return take_place(self.spark, f"{self.path}/log/{place:09d}.json", json.dumps({"place": place, "batch": batch, "folded": folded}))

    def _newest(self, log: list[dict], of: DataFrame | None = None) -> DataFrame:
        """(bucket, doc_id, version, record) with each document's newest record, gone ones too; of: only those documents."""
        parts = None
        for k, entry in enumerate(log):
            part = self.spark.read.schema(f"{RECORD}, bucket int").parquet(f"{self.path}/record/{entry['batch']}").withColumn("place", F.lit(k))
            parts = part if parts is None else parts.union(part)
        if parts is None:
            parts = self.spark.createDataFrame([], f"{RECORD}, bucket int, place int")
        if of is not None:
            own = [r.bucket for r in of.select("bucket").distinct().collect()]
            parts = parts.where(F.col("bucket").isin(own))
            ids = [r.doc_id for r in of.select("doc_id").limit(FEW + 1).collect()]
            parts = (parts.where(F.col("doc_id").isin(ids)) if len(ids) <= FEW else parts).join(of.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        return parts.groupBy("bucket", "doc_id", "version").agg(F.max_by(F.struct("present", "source", "lang", "n_tokens"), "place").alias("record"))

    def state(self) -> DataFrame:
        """(doc_id, version, source, lang, n_tokens) of the documents that are in."""
        return self._newest(self._log()[1]).where("record.present").select("doc_id", "version", "record.source", "record.lang", "record.n_tokens")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens): the sums of the deltas; groups without documents are left out."""
        log = self._log()[1]
        deltas = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/delta/{r['batch']}" for r in log]) if log else self.spark.createDataFrame([], DELTA)
        return summed(deltas).where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes (doc_id, version, op, source, lang, n_tokens) and tells whether the batch was new.

        op: ``upsert`` puts a document in or revises its count, source and language; ``delete`` takes it out (the
        other fields may be null). What a document had is taken off the totals, what it has is added. A delete of a
        document that isn't in changes nothing. Of repeated rows of one document and version the one with the largest
        count wins, and an upsert over a delete; rows without doc_id, version or a known op are left out. Null
        sources and languages are groups of their own; a null or negative count counts as 0. batch: letters, digits,
        ``-`` and ``_``. An empty batch is logged like others. Where another writer commits first, the batch is held
        against what that left.
        """
        written = False
        while True:
            place, log = self._log()
            if any(batch == r["batch"] or batch in (r["folded"] or []) for r in log):
                return False
            if not written:  # written out once: counts can be dear
                rank = F.struct((F.col("op") == "upsert").alias("present"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens"), "source", "lang")
                asked = changes.where("doc_id is not null and version is not null and op in ('upsert', 'delete')").groupBy("doc_id", "version").agg(F.max(rank).alias("new"))
                rows = asked.select("doc_id", "version", "new.present", "new.source", "new.lang", "new.n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
                self._write(rows, batch)
                written = True
            new = self.spark.read.schema(f"{RECORD}, bucket int").parquet(f"{self.path}/record/{batch}")
            old = self._newest(log, new).where("record.present").drop("bucket")
            both = new.join(old, ["doc_id", "version"], "left")
            one = F.lit(1).cast("long").alias("n_docs")
            taken = both.where("record is not null").select("record.source", "record.lang", "version", (-one).alias("n_docs"), (-F.col("record.n_tokens")).alias("n_tokens"))
            added = both.where("present").select("source", "lang", "version", one, "n_tokens")
            summed(taken.union(added)).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")
            if self._enter(place, batch):
                if len(log) >= FOLD:
                    self.fold()
                return True

    def _write(self, rows: DataFrame, batch: str) -> None:
        # adaptive execution splits buckets that are large and joins those that are small
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/record/{batch}")

    def fold(self) -> bool:
        """Writes what all batches left as one, which takes their place; the names of theirs stay known. False if another
        writer committed meanwhile: nothing changed then."""
        place, log = self._log()
        name, names = f"fold-{place}-{uuid.uuid4().hex}", [x for r in log for x in (r["folded"] or [r["batch"]])]
        newest = self._newest(log).where("record.present")
        self._write(newest.select("doc_id", "version", "record.present", "record.source", "record.lang", "record.n_tokens", "bucket"), name)
        self.totals().withColumn("batch", F.lit(name)).write.mode("overwrite").parquet(f"{self.path}/delta/{name}")
        return self._enter(place, name, names)


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))


def token_counts(docs: DataFrame, count: Callable[[], Callable[[list[str]], list[int]]], version: str) -> DataFrame:
    """Changes that put in each row of docs (doc_id, text, source, lang) with the count of its whole text; null: 0.

    count makes, once in each task, a function from texts to counts. No shuffle.
    """
    schema = T.StructType.fromDDL("doc_id long, source string, lang string, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = count()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                n = counter([t or "" for t in batch.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=schema.names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema).withColumn("version", F.lit(version)).withColumn("op", F.lit("upsert"))


def tiktoken_counter(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """A counter by a vocabulary file of ranks and its word pattern."""

    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coder.encode_ordinary(t)) for t in texts]

    return make


def refresh(spark: SparkSession, path: str, docs: DataFrame, count: Callable[[], Callable[[list[str]], list[int]]], version: str) -> TokenLedger:
    """A ledger that took in docs: first all rows with a count from n_chars (four characters a token), so totals are
    there at once; then the counts of the whole texts revise them. Null, empty and blank texts are documents of 0 tokens;
    rows with a null doc_id are left out, of rows that repeat one the largest count stays; extra columns aren't read;
    an empty table gives a ledger without totals. The counts come a second time, as after a lost driver, and change
    nothing."""
    ledger = TokenLedger(spark, path)
    estimate = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.ceil(F.col("n_chars") / 4).cast("long").alias("n_tokens"), F.lit(version).alias("version"), F.lit("upsert").alias("op"))
    ledger.commit("estimate", estimate)
    counts = token_counts(docs, count, version)
    ledger.commit("counts", counts)
    ledger.commit("counts", counts)
    return ledger
