"""Embedding near-dedup: links at a high cosine, found by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.pairs import LEFT, RIGHT, compare, deal, hot_keys
from sluice.llm.shared import components, cut, forest, partitions

#: Vectors that codebooks and the radius are fitted on, at most.
SAMPLE = 8192
#: Cells of one codebook, at most; the grid has the square of it.
MOST_CELLS = 1024
CELLS = MOST_CELLS**2
#: Vectors that are compared with others at a time.
SIDE = 512
#: Vectors of one label that a cell is meant to hold: comparing them costs about what taking one more row there does.
CELL = 400


class Index(NamedTuple):
    """books: a codebook for each half of the unit vectors; radius: how far a traversal goes."""

    books: tuple[np.ndarray, np.ndarray]
    radius: float


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = squares(points, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :])


def halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (unit.shape[1] + 1) // 2
    return unit[:, :middle], unit[:, middle:]


def bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre, and its squared distance from the plane halfway between that and each centre,
    beyond which that centre's region lies."""
    square = squares(points, centres)
    own = square.argmin(1)
    far = 2 * np.sqrt(squares(centres, centres))[own]
    gap = np.where(far > 1e-9, (square - square[np.arange(len(own)), own][:, None]) / np.where(far > 1e-9, far, 1), 0)
    return own, gap**2


def fit(sample: np.ndarray, rows: float, cosine: float, recall: float, cells: int | None = None) -> Index:
    """Codebooks of about sqrt(rows / CELL) cells a half, and the radius within which a share ``recall`` of vectors
    at just ``cosine`` from a sampled one have their cell (and the same of the sample's own links)."""
    rng = np.random.default_rng(7)
    k = cells or int(np.clip(2 ** round(np.log2(max(1, rows / CELL)) / 2), 2, MOST_CELLS))
    books = tuple(k_means(h, k, rng) for h in halves(sample))
    picked = sample[rng.permutation(len(sample))[:2048]]
    turn = rng.standard_normal((4, *picked.shape))
    turn -= (turn * picked).sum(-1, keepdims=True) * picked
    norm = np.linalg.norm(turn, axis=-1, keepdims=True)
    moved = cosine * picked + np.sqrt(max(0.0, 1 - cosine**2)) * turn / np.where(norm > 0, norm, 1)
    far = []
    sets = [(picked, m) for m in moved]
    i, j = np.nonzero(np.triu(picked @ picked.T >= cosine, 1))
    if len(i):
        some = rng.permutation(len(i))[:20_000]
        sets += [(picked[i[some]], picked[j[some]])]
    for a, b in sets:
        total = np.zeros(len(a))
        for book, x, y in zip(books, halves(a), halves(b)):
            if book.shape[1]:
                total += bounds(x, book)[1][np.arange(len(x)), squares(y, book).argmin(1)]
        far.append(np.quantile(total, recall))
    return Index(books, float(max(far)))


def traverse(first: np.ndarray, second: np.ndarray, radius: float) -> Iterator[tuple[int, int]]:
    """Cells of the grid in the order of the sum of both halves' distances, up to radius: the multi-sequence
    algorithm, which goes from a cell to its next ones in either half's order."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, pushed = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > radius:
            return
        yield int(a[i]), int(b[j])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(x) and v < len(y) and (u, v) not in pushed:
                pushed.add((u, v))
                heapq.heappush(heap, (x[u] + y[v], u, v))


def key_of(label: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A bucket's key. Labels that share one are told apart when pairs are verified."""
    mixed = label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)
    return mixed.astype(np.int64) * CELLS + cell


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: a label, and a vector of finite components that aren't all zero."""
    e = F.col("embedding")
    return vectors.where(
        F.col("vec_id").isNotNull() & F.col("group").isNotNull() & e.isNotNull() & (F.size(e) > 0)
        & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    )


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_groups(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.9999, sample: int = SAMPLE, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least
    ``cosine``. Those without a usable vector or label link nothing: n_links 0, component_id their own id, kept.
    Vectors of other lengths don't link either (each length is compared by itself). Labels of any type that can be
    compared will do. Rows that repeat a vec_id count once: of those that can link, the one with the smallest label, or
    with equal labels the smallest digest of the vector; a null vec_id is left out. Extra columns aren't read; an empty
    table gives no rows.

    The index is fitted on a bounded sample, every vector is in it. A vector is compared with its own cell and with
    the later cells (the earlier ones come to it) that a traversal visits until the share ``recall`` of pairs is
    expected; every pair found is verified. Equal vectors of a label are one class; a cell beyond ``block`` vectors
    is dealt into tiles.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    values = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"  # floats travel as floats
    rows = numbered(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(values).alias("embedding")).where("vec_id is not null"))
    # vectors are told apart by 128 bits, so that they themselves are shuffled for one of each class alone
    digest = [F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit("two"), "embedding").alias("two")]
    once = cut(
        usable(rows).select("vec_id", "group", *digest).groupBy("vec_id").agg(F.min(F.struct("group", "one", "two")).alias("x")).select("vec_id", "x.*")
    )
    classes = cut(once.groupBy("group", "one", "two").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    held = usable(rows).select("vec_id", "group", "embedding", *digest).join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "group", "one", "two"])
    held = cut(held.select(F.col("vec_id").alias("rep"), F.col("group").alias("label"), "size", "embedding").dropDuplicates(["rep"]))
    contributions = None
    for width in [r.width for r in held.groupBy(F.size("embedding").alias("width")).count().where("count > 1").orderBy("width").collect()]:
        part = held.where(F.size("embedding") == width)
        found = cut(linked(part, part.count(), width, cosine, recall, sample, block, partitions(spark)))
        contributions = found if contributions is None else contributions.union(found)
    if contributions is None:
        contributions = spark.createDataFrame([], "rep long, n long, other long")
    counts = contributions.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    edges = contributions.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    of_class = (
        classes.join(counts, "rep", "left")
        .join(components(edges), F.col("rep") == F.col("node"), "left")
        .select("group", "one", "two", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    members = once.join(of_class, ["group", "one", "two"]).select("vec_id", "n_links", "component_id")
    return rows.select("vec_id").distinct().join(members, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, ...) with a column group: a long for each label, null for none. Integers are their own,
    labels of other types have their 64-bit hash."""
    if isinstance(rows.schema["label"].dataType, T.IntegralType):
        return rows.withColumn("group", F.col("label").cast("long"))
    return rows.withColumn("group", F.when(F.col("label").isNotNull(), F.xxhash64("label")))


def linked(classes: DataFrame, rows: int, width: int, cosine: float, recall: float, sample: int, block: int, tasks: int) -> DataFrame:
    """(rep, n, other): n vectors more that link with rep, or a link (rep, other) of a forest."""
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow().column("embedding")
    labels = max(1, classes.agg(F.approx_count_distinct("label").alias("n")).first().n)
    index = fit(units(matrix(chosen, width)), rows // labels, cosine, recall)
    grid = len(index.books[0]), len(index.books[1])
    narrow = isinstance(classes.schema["embedding"].dataType.elementType, T.FloatType)

    def places(unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's cell, and each half's distances."""
        near = [bounds(h, book) if h.shape[1] else (np.zeros(len(h), np.int64), np.zeros((len(h), len(book)))) for h, book in zip(halves(unit), index.books)]
        return near[0][0] * grid[1] + near[1][0], [x[1] for x in near]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = places(units(matrix(batch.column(1), width)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(key_of(batch.column(0).to_numpy(), cell))], names=["key"])

    counts = cut(classes.select("label", "embedding").mapInArrow(count, "key long").groupBy("key").agg(F.count("*").alias("n")))
    # both are bounded, by the grid and by rows / block
    occupied = np.zeros(grid, bool)
    occupied.reshape(-1)[[r.cell for r in counts.select((F.col("key") % CELLS).alias("cell")).distinct().collect()]] = True
    hot = hot_keys(counts, max(block, rows // 4096))
    schema = "tile long, kind int, label long, rep long, size long, embedding binary"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                label, size, rep = (batch.column(c).to_numpy() for c in ("label", "size", "rep"))
                raw = matrix(batch.column("embedding"), width)
                cell, near = places(units(raw))
                row, visits = [], []
                for i in range(len(cell)):
                    for x, y in traverse(near[0][i], near[1][i], index.radius):
                        c = x * grid[1] + y
                        if c > cell[i] and occupied[x, y]:
                            row.append(i)
                            visits.append(c)
                at = np.append(np.arange(len(cell)), np.array(row, np.int64))
                key = key_of(label[at], np.append(cell, np.array(visits, np.int64)))
                # a cell's blocks: by the vector's id
                spot = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                copy, tile, kind, _ = deal(key, np.arange(len(key)) >= len(cell), spot[at], hot)
                at = at[copy]
                binary = np.array([r.tobytes() for r in (raw.astype(np.float32) if narrow else raw)], object)
                for s in range(0, len(at), 20_000):
                    a = at[s : s + 20_000]
                    columns = [pa.array(tile[s : s + 20_000]), pa.array(kind[s : s + 20_000].astype(np.int32)), *(pa.array(c[a]) for c in (label, rep, size)), pa.array(binary[a], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["tile", "kind", "label", "rep", "size", "embedding"])

    def links(table: pa.Table, starts: np.ndarray, kind: np.ndarray, again: bool) -> Iterator[pa.RecordBatch]:
        rep, size, label = (table.column(c).to_numpy() for c in ("rep", "size", "label"))
        unit = units(np.frombuffer(b"".join(table.column("embedding").to_pylist()), np.float32 if narrow else np.float64).astype(np.float64).reshape(-1, width))
        n = np.zeros(len(rep), np.int64)
        found_a, found_b = [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            left = lo + int(np.searchsorted(kind[lo:hi], LEFT, side="right"))
            if left == lo or hi - lo < 2:
                continue
            inner = kind[hi - 1] != RIGHT and not (again and lo == 0)
            # a product is of SIDE by 4096 at most, however large the cell's blocks are
            for x in range(lo, left, SIDE):
                for y in range(x if inner else left, hi, 4096):
                    i, j = np.nonzero(unit[x : min(x + SIDE, left)] @ unit[y : min(y + 4096, hi)].T >= cosine)
                    i, j = i + x, j + y
                    ok = (i < j) & (label[i] == label[j])
                    i, j = i[ok], j[ok]
                    if len(i):
                        found_a.append(i)
                        found_b.append(j)
        if found_a:
            i, j = np.concatenate(found_a), np.concatenate(found_b)
            np.add.at(n, i, size[j])
            np.add.at(n, j, size[i])
            a, b = forest(rep[i], rep[j])
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(rep[some], a)), pa.array(np.append(n[some], np.zeros(len(a), np.int64))), pa.array([None] * len(some) + b.tolist(), pa.int64())], names=["rep", "n", "other"]
            )

    return compare(classes.mapInArrow(spread, schema), links, "rep long, n long, other long", tasks)
