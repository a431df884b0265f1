"""Vector code compression: product codes in whole numbers, each part's nearest entry found in a kd-tree.

Vectors are cut into equal parts, each with a codebook of its own. A round sends a kd-tree of each codebook to the tasks,
assigns every part to its nearest entry, and moves the entries to the means of their parts, from sums that the cluster
adds up. Everything is integer arithmetic, so the codes don't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.shared import fresh_path

#: Entries of a leaf of a tree, at most (more only where they are equal).
LEAF = 4
#: Whole components are below this in size, so that squared distances of up to 2**10 components fit 64 bits.
LARGEST = 1 << 25


@dataclass
class Node:
    """A box around some entries of a codebook: a leaf has their indexes in ascending order, others two nodes."""

    low: np.ndarray
    high: np.ndarray
    entries: list[int] = field(default_factory=list)
    sides: tuple[Node, Node] | None = None


def tree_of(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: halves at the median of the widest component."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    node = Node(own.min(0), own.max(0))
    wide = int((node.high - node.low).argmax()) if book.shape[1] else 0
    if len(entries) <= LEAF or node.high[wide] == node.low[wide]:
        node.entries = sorted(entries.tolist())
        return node
    order = entries[np.argsort(own[:, wide], kind="stable")]
    middle = len(order) // 2
    node.sides = tree_of(book, order[:middle]), tree_of(book, order[middle:])
    return node


def nearest(book: np.ndarray, tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry and its squared distance; of entries at the same distance the lowest index.

    Branch and bound for many points at once: a point goes to the nearer box first, and to the other unless that is
    farther than what it has found. A box at just that distance is visited too, as it may hold an equal entry of a lower
    index.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.full(len(points), len(book))

    def outside(node: Node, at: np.ndarray) -> np.ndarray:
        p = points[at]
        gap = np.maximum(node.low - p, 0) + np.maximum(p - node.high, 0)
        return (gap * gap).sum(1)

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        for k in node.entries:
            gap = points[at] - book[k]
            far = (gap * gap).sum(1)
            closer = (far < best[at]) | ((far == best[at]) & (k < entry[at]))
            best[at[closer]], entry[at[closer]] = far[closer], k
        if node.sides:
            bounds = [outside(side, at) for side in node.sides]
            first = bounds[0] <= bounds[1]
            for near, mine in ((0, first), (1, ~first)):
                rows = at[mine]
                visit(node.sides[near], rows)
                visit(node.sides[1 - near], rows[bounds[1 - near][mine] <= best[rows]])

    visit(tree, np.arange(len(points)))
    return entry, best


@dataclass
class Codebooks:
    """books: for each part, in order, its entries as rows of whole numbers; scale: what components were multiplied by."""

    books: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.reshape(-1).tolist()).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([b[k] for b, k in zip(self.books, code)]) / self.scale


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector has components, all of them finite and of a size that whole
    numbers of LARGEST hold."""
    e = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType
    values = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    bound = F.lit(LARGEST / scale)
    return vectors.select("vec_id", "label", e.cast(values).alias("embedding")).where(
        e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    )


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """The vectors of a batch as a matrix of floor(scale * x)."""
    flat = np.asarray(column.flatten(), np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def fit_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds, which begin at the parts of the vectors with the smallest vec_ids.

    Rows that can't be used and rows of another length than those codebooks count nothing (see compress()). None if no
    row can be used. A round reads the vectors once; a task sends the sums of its parts for each entry, and the driver
    gets one row for each entry of each part. An entry without parts stays.
    """
    if not 1 <= entries <= 256:
        raise ValueError("A code has a byte for each part, so a codebook has 1 to 256 entries.")
    spark, rows = vectors.sparkSession, usable(vectors, scale)
    fits = rows.where(F.size("embedding") % parts == 0)
    first = fits.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").first()
    if first is None:
        return None
    width = len(first.embedding)
    rows = rows.where(F.size("embedding") == width)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = np.floor(np.array([r.embedding for r in seeds], np.float64) * scale).astype(np.int64)
    found = Codebooks(np.split(start, parts, axis=1), scale)
    each = width // parts
    for _ in range(rounds):
        total = assigned_sums(spark, rows, found)
        for r in total.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k].cast("decimal(20,0)")).alias(f"t{k}") for k in range(each))).collect():
            found.books[r.part][r.entry] = [int(r[f"t{k}"]) // r.n for k in range(each)]
    return found


def assigned_sums(spark: SparkSession, rows: DataFrame, found: Codebooks) -> DataFrame:
    """(part, entry, n, total): how many parts of a task are nearest to an entry, and their sums."""
    sent, scale = spark.sparkContext.broadcast([(b, tree_of(b)) for b in found.books]), found.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        counts = [np.zeros(len(b), np.int64) for b, _ in books]
        totals = [np.zeros(b.shape, np.int64) for b, _ in books]
        for batch in batches:
            if batch.num_rows:
                for k, ((book, tree), points) in enumerate(zip(books, np.split(whole(batch.column(0), scale), len(books), axis=1))):
                    entry = nearest(book, tree, points)[0]
                    counts[k] += np.bincount(entry, minlength=len(book))
                    np.add.at(totals[k], entry, points)
        some = [(k, e, int(counts[k][e]), totals[k][e].tolist()) for k in range(len(books)) for e in np.flatnonzero(counts[k]).tolist()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "total"])

    return rows.select("embedding").mapInArrow(run, "part int, entry int, n long, total array<long>")


def encode(vectors: DataFrame, found: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of the rows that the codebooks fit: a byte for each part, and the sum of its parts'
    squared distances from their entries. No shuffle."""
    sent, scale = vectors.sparkSession.sparkContext.broadcast([(b, tree_of(b)) for b in found.books]), found.scale
    rows = usable(vectors, scale).where(F.size("embedding") == found.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            if batch.num_rows:
                codes, error = np.zeros((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, np.int64)
                for k, ((book, tree), points) in enumerate(zip(books, np.split(whole(batch.column(2), scale), len(books), axis=1))):
                    codes[:, k], far = nearest(book, tree, points)
                    error += far
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every vector that can be coded.

    code: a byte for each part; error: the squared distance between the vector and what its code stands for, in units of
    1 / scale; label_error: the sum of the errors of all rows with an equal label, null labels together.

    Left out are vectors that are null, empty, hold null or non-finite components or such of 2**25 / scale and more
    in size, and vectors of another length than that with the smallest vec_id whose length divides into the parts.
    Rows that repeat a vec_id, or have none, count each (null ids come last in the choice of the first entries, repeated
    ones in the order of their vectors). With fewer rows than entries a codebook has as many entries as rows. Extra
    columns aren't read; an empty table gives no rows.

    Coded rows are written out once, so that labels are summed without coding anew. Sums by label are taken before the
    shuffle; they come back by a join that sends few labels to the rows and, where there are many, splits a label that
    has much of the table.
    """
    spark = vectors.sparkSession
    found = fit_codebooks(vectors, parts, entries, rounds, scale)
    if found is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code binary, error long, label_error long, codebooks_sha256 string")
    path = fresh_path(spark, "codes")
    encode(vectors, found).write.parquet(path)
    coded = spark.read.parquet(path)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
