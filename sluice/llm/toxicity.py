"""Toxicity: cumulative-link ordinal regression on the words of a text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W\d_]+")
#: Columns of the feature matrix; words that share one (few do) share a weight.
WIDTH = 1 << 20
#: Words without weight that a worker remembers, at most (but for those of one text).
MEMO = 200_000


def features(text: str | None) -> set[str]:
    """The distinct words (runs of letters) of a whole text, in lower case, and the first letters of the longer ones (``moro*``), which inflected forms share."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union([w[:4] + "*" for w in words if len(w) > 4], [w[:5] + "*" for w in words if len(w) > 5])


def column(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % WIDTH


def columns_of(text: str | None) -> set[int]:
    """The columns that hold a one for a text."""
    return set(map(column, features(text)))


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . columns - cuts[k]): one weight for each column, shared by all the ordered cuts."""

    weights: dict[int, float] = field(default_factory=dict)
    cuts: tuple[float, ...] = (np.inf,)
    plain: set[str] = field(default_factory=set, repr=False, compare=False)  # words met whose columns have no weight

    def exceed(self, texts: Iterable[str | None]) -> np.ndarray:
        """A row for each text: P(grade > k) for each cut."""
        score, weights, plain = [], self.weights, self.plain
        for text in texts:
            fresh = features(text).difference(plain)
            found = {w: column(w) for w in fresh}
            heavy = {c for c in found.values() if c in weights}
            score.append(math.fsum(weights[c] for c in heavy))
            plain.update(fresh if not heavy else [w for w, c in found.items() if c not in weights])
            if len(plain) > MEMO:
                plain.clear()
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - np.array(score, float)[:, None], -500, 500)))


def fit_matrix(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, levels: int, l1: float, rounds: int = 60, more: int = 500, steps: int = 400, slack: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that minimise the mean of the cumulative logistic losses plus l1 times the weights' size.

    rows, columns: where the binary feature matrix holds ones. The penalty keeps words without evidence at zero, so the
    descent runs over a working set: in each round the ``more`` columns join it whose slope exceeds the penalty the
    most, until none exceeds it by over the share ``slack``, which is the condition of the minimum; every column is
    looked at in every round.
    """
    over = (grades[:, None] > np.arange(levels - 1)).astype(float)
    rate = np.clip(over.mean(0), 1e-4, 1 - 1e-4)
    weight, cuts, score = np.zeros(width), -np.log(rate / (1 - rate)), np.zeros(len(grades))
    for _ in range(rounds):
        error = (1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500))) - over) / len(grades)
        slope = np.bincount(columns, weights=error.sum(1)[rows], minlength=width)
        beyond = np.where(weight != 0, np.abs(slope + l1 * np.sign(weight)), np.abs(slope) - l1)
        if not width or beyond.max() <= slack * l1:
            break
        inside = weight != 0
        worst = np.argsort(-beyond, kind="stable")[:more]
        inside[worst[beyond[worst] > 0]] = True
        place = np.cumsum(inside) - 1
        some = inside[columns]
        own, cuts, score = descend(rows[some], place[columns[some]], over, weight[inside], cuts, l1, steps)
        weight[inside] = own
    return weight, cuts


def descend(rows: np.ndarray, columns: np.ndarray, over: np.ndarray, weight: np.ndarray, cuts: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, cuts and the rows' scores after accelerated proximal gradient descent from weight and cuts. The cuts are
    kept in order. A step that would raise the loss is taken anew from the last point, shorter."""
    n, levels = len(over), over.shape[1] + 1
    step_w = np.minimum(50.0, 0.8 * n / (np.maximum(1, np.bincount(columns, minlength=len(weight))) * (levels - 1)))
    shorter = 1.0

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=w[columns], minlength=n)

    def loss(score: np.ndarray, c: np.ndarray, w: np.ndarray) -> float:
        x = score[:, None] - c[None, :]
        return float((np.logaddexp(0, x) - over * x).sum() / n + l1 * np.abs(w).sum())

    w_old, c_old, s_old, momentum = weight, cuts, scores(weight), 1.0
    look_w, look_c, look_s, best = w_old, c_old, s_old, loss(s_old, c_old, w_old)
    for _ in range(steps):
        error = (1 / (1 + np.exp(np.clip(look_c[None, :] - look_s[:, None], -500, 500))) - over) / n
        step = shorter * step_w
        new = look_w - step * np.bincount(columns, weights=error.sum(1)[rows], minlength=len(weight))
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
        cut = np.maximum.accumulate(look_c + shorter * error.sum(0))
        score = scores(new)
        now = loss(score, cut, new)
        if now > best + 1e-13:
            if momentum == 1.0:  # a plain step that leads up is too long
                shorter /= 2
            look_w, look_c, look_s, momentum = w_old, c_old, s_old, 1.0
            continue
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        beta = (momentum - 1) / later
        look_w, look_c, look_s = new + beta * (new - w_old), cut + beta * (cut - c_old), score + beta * (score - s_old)
        w_old, c_old, s_old, momentum, best = new, cut, score, later, now
    return w_old, c_old, s_old


def fit(docs: DataFrame, graded: DataFrame, sample: int = 8192, l1: float = 2e-4, levels: int | None = None) -> OrdinalModel:
    """A model from graded (doc_id, grade), grades 0, 1, 2, ...

    sample: how many graded rows it is fitted on at most, those whose doc_id hashes lowest; all their words count. The
    driver gets their columns, at most WIDTH for each. A null doc_id or grade counts as no label; of repeated labels
    the highest grade counts, and copies of one text count once. A null text has no words. Without usable labels the
    model predicts grade 0 for all. Extra columns aren't read.
    """
    spark = docs.sparkSession
    labels = graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max(F.greatest("grade", F.lit(0))).cast("int").alias("grade"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not chosen:
        return OrdinalModel()
    few = spark.createDataFrame([(r.doc_id, r.grade) for r in chosen], "doc_id long, grade int")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(np.fromiter(columns_of(t.as_py()), np.int32)) for t in batch.column(2)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lists], names=["doc_id", "grade", "key", "ones"])

    # copies of one text count once, or a large group of copies would be most of the sample
    bags = picked.select("doc_id", "grade", "text", F.sha2("text", 256).alias("key")).mapInArrow(split, "doc_id long, grade int, key string, ones array<int>")
    data = bags.groupBy("key").agg(F.max("grade").alias("grade"), F.min("doc_id").alias("doc_id"), F.first("ones").alias("ones")).drop("key").toArrow().sort_by("doc_id")
    if not data.num_rows:
        return OrdinalModel()
    grades = data.column("grade").to_numpy()
    lists = data.column("ones").combine_chunks()
    known, columns = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    rows = np.repeat(np.arange(len(grades)), lists.value_lengths().to_numpy(zero_copy_only=False))
    levels = levels or max(2, int(grades.max(initial=0)) + 1)
    weight, cuts = fit_matrix(rows, columns, grades, len(known), levels, l1)
    return OrdinalModel({int(k): float(x) for k, x in zip(known, weight) if abs(x) > 1e-9}, tuple(float(c) for c in cuts))


def grades_of(labels: DataFrame) -> DataFrame:
    """Severity grades from the labels toxic and quality: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0).alias("grade"))


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, expected_severity, grade, rejected) for every row.

    expected_severity: the sum of P(grade > k); grade: how many of them reach one half; rejected: P(grade > 0) is
    at least ``threshold``. A null, empty or wordless text is scored by the cuts alone. Repeated rows and null ids
    give a row each, other columns are not read, an empty table gives no rows. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.exceed(t.as_py() for t in batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= threshold)], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() does not reject; columns as they were, whatever their names. Null and empty texts are
    judged by the cuts alone; repeated rows and null ids are judged each; an empty table gives no rows. No shuffle."""
    text = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.exceed(t.as_py() for t in batch.column(text))[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)
