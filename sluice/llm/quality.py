"""Quality rules: fixed thresholds on what a text holds, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the feature space, as a power of two; n-grams that share one share a weight.
BITS = 18
#: Characters that count as symbols, and what parts words, as bytes.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Words of a window, the fewest words of a text, and the largest share of repeated words in percent.
WINDOW, FEWEST, REPEATED = 8, 20, 30
#: Texts of the sample that a column needs to get a weight.
FEW = 3
#: Odd numbers that mix hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """A number for each word, equal for equal words, and the numbers of the different ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), known


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in a window of so many words (a power of two) that occurs twice or more; exactly: windows are
    numbered from pairs of windows of half their length."""
    if len(ids) <= window:
        return 0
    step = 1
    while step < window:
        pairs = ids[:-step] * (len(ids) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(ids) + window, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measures(text: str | None, raw: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < FEWEST or 100 * n_repeat_words > REPEATED * n_words


def grams(text: str | None, ids: np.ndarray, known: dict[bytes, int]) -> list[np.ndarray]:
    """The columns of a text's n-grams, repeats included: of one and two words (two that are equal have one column, whatever
    the word), and of three and four characters."""
    shift = np.uint64(64 - BITS)
    word = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[ids] if known else np.zeros(0, np.uint64)
    of_words = [word, np.where(ids[:-1] == ids[1:], np.uint64(1), word[:-1] * MIX[0] + word[1:])]
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    three = c[:-2] * MIX[1] + c[1:-1] * MIX[2] + c[2:] * MIX[3] if len(c) > 2 else c[:0]
    four = three[:-1] * MIX[0] + c[3:] if len(c) > 3 else c[:0]
    return [np.concatenate([(h * MIX[k] + np.uint64(k) >> shift) for k, h in group]).astype(np.int64) for group in (enumerate(of_words), enumerate([three, four], 2))]


@dataclass
class QualityModel:
    """P(good) = sigmoid(slope * score + shift) with score the mean weight of a text's word n-grams, and that of its
    character n-grams, together with bias. Without weights every text is good."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 30.0

    def score(self, columns: list[np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[c].mean(dtype=np.float64)) for c in columns if len(c))

    def probability(self, score: np.ndarray | float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(score, float) + self.shift, -500, 500)))


def descend(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, good: np.ndarray, width: int, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss with both classes of equal weight, plus a penalty on the
    weights' squares: accelerated gradient descent, which starts anew where it would lead up."""
    n = len(good)
    share = np.where(good > 0, 0.5 / max(1.0, good.sum()), 0.5 / max(1.0, n - good.sum()))
    sizes = np.bincount(rows, weights=values**2, minlength=n) + 1
    rate = 1 / (0.25 * np.quantile(sizes, 0.98) + penalty)
    x = look = np.zeros(width + 1)
    t, before = 1.0, np.inf
    for _ in range(steps):
        score = np.bincount(rows, weights=look[columns] * values, minlength=n) + look[-1]
        loss = float((share * (np.logaddexp(0, score) - good * score)).sum() + penalty / 2 * (look[:-1] ** 2).sum())
        if abs(before - loss) < 1e-5 * loss:
            break
        if loss > before:
            t = 1.0
        error = share * (1 / (1 + np.exp(-np.clip(score, -500, 500))) - good)
        slope = np.append(np.bincount(columns, weights=error[rows] * values, minlength=width) + penalty * look[:-1], error.sum())
        new, later = look - rate * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, look, t, before = new, new + (t - 1) / later * (new - x), later, loss
    return x[:-1], float(x[-1])


def calibrate(score: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the sigmoid that turns scores of rows that weren't fitted into probabilities (Platt's method,
    with his targets that keep away from 0 and 1), by Newton's steps."""
    yes, no = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    middle, wide = score.mean(), score.std() or 1.0
    z, at = (score - middle) / wide, np.array([0.0, np.log((yes + 1) / (no + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -30, 30)))
        h = p * (1 - p)
        slope = np.array([((p - target) * z).sum() + 1e-3 * at[0], (p - target).sum()])
        bend = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(bend, slope)
        at = at - move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
    return float(at[0] / wide), float(at[1] - at[0] * middle / wide)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2048, penalty: float = 1e-3, steps: int = 150) -> QualityModel:
    """A model from labels (doc_id, quality): 1 good, 0 not.

    sample: how many labelled rows are used at most, half of them of either class, those whose doc_id hashes lowest; a
    quarter of them, by hash too, isn't fitted but calibrates the probabilities, which then are set to the share of good
    ones among all labels. The driver gets the n-grams of the sample's whole texts, once for each column.
    Labels without doc_id or quality don't count; of repeated labels the lowest counts, and copies of one text count
    once. Where one class is missing in either part the model calls all texts good. Extra columns aren't read.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    share = usable.agg(F.avg("good").alias("good")).first().good
    chosen = [r for k in (0, 1) for r in usable.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2).collect()]
    if share in (None, 0, 1):
        return QualityModel()
    few = spark.createDataFrame([(r.doc_id, r.good) for r in chosen], "doc_id long, good int")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(few), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                columns = grams(text, *numbered(text.encode("utf-8", "surrogatepass").split()))
                one = [np.unique(c, return_counts=True) for c in columns]
                found.append((np.concatenate([a for a, _ in one]), np.concatenate([n / max(1, n.sum()) for _, n in one]).astype(np.float32)))
            ends = pa.array(np.cumsum([0, *(len(a) for a, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *(x[k] for x in found)]).astype(kind))) for k, kind in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *lists], names=["doc_id", "good", "key", "at", "share"])

    bags = picked.select("doc_id", "good", "text", F.sha2("text", 256).alias("key")).mapInArrow(split, "doc_id long, good int, key string, at array<int>, share array<float>")
    once = bags.groupBy("key").agg(F.min("good").alias("good"), F.min("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("share").alias("share"))
    data = once.withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), "key"), F.lit(4)) == 0).drop("key").toArrow().sort_by("doc_id")
    if not data.num_rows:
        return QualityModel()
    good, aside = data.column("good").to_numpy().astype(float), data.column("aside").to_numpy(zero_copy_only=False)
    if min(good[aside].sum(), (1 - good[aside]).sum(), good[~aside].sum(), (1 - good[~aside]).sum()) == 0:
        return QualityModel()
    lists = data.column("at").combine_chunks()
    rows = np.repeat(np.arange(len(good)), lists.value_lengths().to_numpy(zero_copy_only=False))
    known, columns = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    values = data.column("share").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    # columns of a few texts tell of these alone
    often = np.bincount(columns)[columns] >= FEW
    rows, values = rows[often], values[often]
    known, columns = np.unique(known[columns[often]], return_inverse=True)
    # a column's scale: rare ones weigh more, as in a chi-square distance
    mean = np.bincount(columns, weights=values) / len(good)
    values *= (scale := 1 / np.sqrt(mean + 1e-4))[columns]
    fitted = ~aside[rows]
    weight, bias = descend(np.cumsum(~aside)[rows[fitted]] - 1, columns[fitted], values[fitted], good[~aside], len(known), penalty, steps)
    score = np.bincount(rows, weights=weight[columns] * values, minlength=len(good)) + bias
    out = np.zeros(1 << BITS, np.float32)
    out[known] = weight * scale
    slope, shift = calibrate(score[aside], good[aside])
    prior = np.log(share / (1 - share)) - np.log(good[aside].sum() / (1 - good[aside]).sum())
    return QualityModel(out, bias, slope, shift + float(prior))


def judge(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) for every row.

    base_failed: under 20 words, or over 30 % of them in windows of eight words that the text repeats. kept: not
    base_failed, and P(good) is at least ``threshold``. A null, empty or blank text has no words and fails; a text of one
    long word is counted whole; rows that repeat a doc_id or have none are judged each; extra columns aren't read; an
    empty table gives no rows. No shuffle; a task holds the weights (1 MB) and a text at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found, failed, score = [], [], []
            for scalar in batch.column(1):
                text = scalar.as_py()
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                ids, known = numbered(words)
                found.append(measures(text, raw, words, ids))
                failed.append(fails(found[-1][0], found[-1][4]))
                score.append(own.score(grams(text, ids, known)))
            p = own.probability(np.array(score))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*found)), pa.array(failed), pa.array(p), pa.array(~np.array(failed) & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
