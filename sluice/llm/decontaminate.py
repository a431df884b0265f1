"""Benchmark decontamination: windows of templates, joined by hash, with a check of what fills their slots."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut

#: Scripts without spaces between words, whose characters are tokens: Thai, Lao, Myanmar, Khmer, kana and Chinese characters.
DENSE = r"\u0E01-\u0E4E\u0E81-\u0ECD\u1000-\u103F\u1780-\u17D3\u3005-\u3007\u3041-\u30FA\u30FC-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D\U00020000-\U0003FFFF"
#: Tokens: words, numbers, and the marks that end a sentence.
TOKEN = re.compile(rf"[^\W\d_{DENSE}]+|\d+(?:[.,]\d+)*|[.!?。！？\n]+|[{DENSE}]")
LITERAL, NUMBER, NAME, UNIT, MARK = range(5)
#: Words that count as numbers (English, German, French, Spanish), and words that are units where they follow a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
NUMBER_WORDS += "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend".split()
NUMBER_WORDS += "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante mille".split()
NUMBER_WORDS += "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien mil".split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres kmh mph "
    "stunde stunden tag tage woche wochen monat monate jahr jahre heure heures jour jours semaine semaines mois an ans hora horas día días semana semanas mes meses año años"
).split()
#: The share of an item's tokens that an alignment covers if numbers no longer count against it.
NEARLY = 0.9
#: Benchmark windows that one scan of the documents is held against, at most: 8 bytes each in every task.
BLOCK = 4_000_000
#: Rows of benchmark windows that are sent to every task, at most; beyond it both sides of a join are shuffled.
BROADCAST = 200_000
#: Tokens whose hashes a worker remembers, at most.
TOKENS = 400_000


class Reader:
    """Token codes of a worker: each distinct token's hash and kind, kept for a bounded number of tokens."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def codes(self, tokens: list[str]) -> np.ndarray:
        fresh = set(tokens).difference(self.code)
        if len(self.code) + len(fresh) > TOKENS:
            self.__init__()
            fresh = set(tokens)
        if fresh:
            start = len(self.code)
            self.code.update(zip(fresh, range(start, start + len(fresh))))
            numbers, units = set(NUMBER_WORDS), set(UNIT_WORDS)
            low = [t.lower() for t in fresh]
            kinds = [MARK if t[0] in ".!?。！？\n" else NUMBER if t[0].isdigit() or x in numbers else NAME if t[0].isupper() and not t.isupper() else UNIT if x in units else LITERAL for t, x in zip(fresh, low)]
            self.hashes = np.append(self.hashes, np.array([xxhash.xxh64_intdigest(x) for x in low], np.uint64))
            self.kinds = np.append(self.kinds, np.array(kinds, np.int8))
        return np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(owner, hash, own hash, kind, token) of each token but marks. A capital makes a name only within a sentence, and
        not in a word all of capitals; a unit is one only after a number; placeholders of a kind have one hash beside their own."""
        found = [TOKEN.findall(t) if t else [] for t in texts]
        tokens = [t for f in found for t in f]
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        code = self.codes(tokens)
        hashes, kinds = self.hashes[code], self.kinds[code].copy()
        if not len(tokens):
            return owner, hashes, hashes, kinds, tokens
        first = np.append(True, owner[1:] != owner[:-1])
        before = np.append(np.int8(MARK), kinds[:-1])
        kinds[(kinds == NAME) & (first | (before == MARK))] = LITERAL
        kinds[(kinds == UNIT) & (first | (before != NUMBER))] = LITERAL
        typed = np.where(kinds == LITERAL, hashes, kinds.astype(np.uint64))
        real = np.flatnonzero(kinds != MARK)
        return owner[real], typed[real], hashes[real], kinds[real], [tokens[k] for k in real.tolist()] if len(texts) < 64 else _Picked(tokens, real)


class _Picked:
    """Some of a list's entries, without a copy."""

    def __init__(self, tokens: list[str], real: np.ndarray):
        self.tokens, self.real = tokens, real

    def __getitem__(self, k: int) -> str:
        return self.tokens[self.real[k]]


def window_hashes(owner: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each window of ``width`` tokens of one text with ``literals`` words at least in their own form."""
    n = len(owner) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    roll = np.full(n, width, np.uint64)
    own = np.append(0, np.cumsum(kinds == LITERAL))
    for k in range(width):
        roll = roll * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n + k]
    roll = (roll ^ roll >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((owner[:n] == owner[width - 1 :]) & (own[width:] - own[:n] >= literals))
    return at, roll[at]


def exact_hashes(owner: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each window of ``width`` tokens of one text by what its tokens are; never a template's hash."""
    at, values = window_hashes(owner, own, np.zeros(len(owner), np.int8), width, 0)
    return at, values ^ np.uint64(0xA5A5A5A55A5A5A5A)


def slots(kinds: np.ndarray, tokens: list[str] | _Picked, start: int, width: int) -> list[str]:
    return [f"{kinds[k]}{tokens[k].lower()}" for k in range(start, start + width) if kinds[k] != LITERAL]


def pattern(fills: list[list[str]]) -> list[tuple[str, int]]:
    """Which slots have the same filler: each slot's kind and the first slot with its filler."""
    first: dict[str, int] = {}
    return [(x[0], first.setdefault(x, len(first))) for fill in fills for x in fill]


def item_windows(benchmark: DataFrame, width: int, least: int) -> DataFrame:
    """(item_id, class, text, tokens, width, place, hash, fill) of every template window of every item. class: alike for
    items with the same template (and the same own words where a window has no template) and the same pattern of equal
    fillers; text: a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                owner, hashes, own, kinds, tokens = reader.read([text])
                n = len(owner)
                size = min(n, width)
                if not n:
                    continue
                plain = (size + 1) // 2
                found = []
                if n >= least:
                    found += [(start, value, slots(kinds, tokens, start, size)) for start, value in zip(*(x.tolist() for x in window_hashes(owner, hashes, kinds, size, plain)))]
                shaped = len(found)
                # windows without enough plain words, were one more of them a name, count as they are
                count = np.append(0, np.cumsum(kinds == LITERAL))
                found += [(start, value, []) for start, value in zip(*(x.tolist() for x in exact_hashes(owner, own, size))) if n < least or count[start + size] - count[start] <= plain]
                # a capital at the item's start may be within a sentence of a document, where it makes a name
                _, hashes, _, kinds, tokens = (x[1 : size + 1] for x in reader.read(["x " + text]))
                if kinds[0] == NAME and n >= least:
                    found += [(0, value, slots(kinds, tokens, 0, size)) for value in window_hashes(np.zeros(size), hashes, kinds, size, plain)[1].tolist()]
                typed = {f[0] for f in found[:shaped]}
                alike = xxhash.xxh3_128_hexdigest(repr((n, [f[:2] for k, f in enumerate(found) if k < shaped or f[0] not in typed], pattern([f[2] for f in found]))))
                digest = xxhash.xxh3_64_hexdigest(text)
                for start, value, fill in found:
                    for column, x in zip(rows, (item, alike, digest, n, size, start, value - (1 << 64 if value >> 63 else 0), fill)):
                        column.append(x)
            kinds_ = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds_)], names=["item_id", "class", "text", "tokens", "width", "place", "hash", "fill"])

    schema = "item_id long, class string, text string, tokens int, width int, place int, hash long, fill array<string>"
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").mapInArrow(run, schema)


def hits(docs: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, at, width, hash, fill) of the documents' windows whose hash, by width, is known. No shuffle."""
    quick = {}
    for size, values in known.items():
        quick[size] = np.zeros(1 << 20, bool)
        quick[size][values >> np.uint64(44)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ids = batch.column(0).to_pylist()
                owner, hashes, own, kinds, tokens = reader.read(batch.column(1).to_pylist())
                begin = np.searchsorted(owner, np.arange(len(ids)))
                out: list[list] = [[] for _ in range(5)]
                for size, values in known.items():
                    for exact in (False, True):
                        at, found = exact_hashes(owner, own, size) if exact else window_hashes(owner, hashes, kinds, size, (size + 1) // 2)
                        maybe = quick[size][found >> np.uint64(44)]
                        at, found = at[maybe], found[maybe]
                        sure = values[np.minimum(np.searchsorted(values, found), len(values) - 1)] == found
                        for start, value in zip(at[sure].tolist(), found[sure].view(np.int64).tolist()):
                            fill = [] if exact else slots(kinds, tokens, start, size)
                            for column, x in zip(out, (ids[owner[start]], start - int(begin[owner[start]]), size, value, fill)):
                                column.append(x)
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "at", "width", "hash", "fill"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, at int, width int, hash long, fill array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, run_tokens: int = 13, share: float = 0.5, agree: float = 0.8, least: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_items, covered, longest, agreement, exact) for each document with passages of benchmark items.

    A text's template is its words in lower case, with typed placeholders for numbers, names (capitals within a
    sentence) and units (after a number). Windows of ``width`` tokens, half of them or more in their own form, are
    joined by hash; an item of fewer tokens is one window. Windows with fewer plain words, and items of under ``least``
    tokens as a whole, are joined by what their tokens are, so verbatim copies of any item are found (of a single word
    too: such items belong in no benchmark). Characters of scripts without spaces are tokens. Windows of a document that
    lie as the item's do form an alignment; in it the same filler of the item must have the same filler in the
    document (for a number, the most frequent one counts as that), for a share ``agree`` of the pairs at least
    (agreement), else it doesn't count. If it covers nearly the whole item, only names and units must agree so.
    Different fillers of the item may have one filler. A document has an item if its alignments
    cover a share ``share`` of the item's tokens (covered), or ``run_tokens`` (or all) of them in a row (longest).

    Items that differ in nothing but what fills their slots, or in windows that no document has, are judged as one class,
    so that many questions of one template, or with one preamble, don't meet many documents of it pair by pair: item_id
    is the smallest id of the class, n_items how many ids it has. exact: the slots of each window of an alignment are filled as in some item of the class, otherwise it is a
    question with other parameters.

    Null ids and texts have no windows; rows that repeat an id count together (an item_id with several texts counts for
    each); empty tables give no rows; extra columns aren't read. The documents are scanned once for each ``block`` of the
    benchmark's windows, whose hashes go to all tasks; only windows of documents that match are shuffled.
    """
    windows = cut(item_windows(benchmark, width, least))
    count = windows.count()
    few = F.broadcast if count <= BROADCAST else lambda df: df
    blocks = max(1, -(-count // block))
    found = None
    for k in range(blocks):
        known: dict[int, np.ndarray] = {}
        for r in windows.where(F.pmod("hash", F.lit(blocks)) == k).groupBy("width").agg(F.collect_set("hash").alias("hashes")).collect():
            known[r.width] = np.sort(np.array(r.hashes, np.int64).view(np.uint64))
        part = hits(docs, known)
        found = part if found is None else found.union(part)
    found = cut(found)
    windows = cut(by_evidence(windows, found))
    lead = F.min(F.struct("item_id", "text", "tokens", "fill"))
    items = windows.groupBy("class").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    leading = windows.groupBy("class", "width", "place", "hash").agg(lead.alias("lead")).select("class", "width", "place", "hash", "lead.tokens", "lead.fill")
    fills = windows.select("class", "place", "hash", F.xxhash64("fill").alias("by"), F.lit(True).alias("same")).distinct()
    joined = found.withColumnRenamed("fill", "filled").join(few(leading), ["width", "hash"]).withColumn("by", F.xxhash64("filled")).join(few(fills), ["class", "place", "hash", "by"], "left")
    joined = joined.withColumn("shift", F.col("at") - F.col("place")).select("doc_id", "class", "shift", "place", "tokens", "width", "fill", "filled", "same").distinct()
    # an alignment has each of the item's windows once at most, however often rows repeat
    aligned = joined.groupBy("doc_id", "class", "shift").agg(
        F.first("tokens").alias("tokens"), F.first("width").alias("width"), F.collect_set("place").alias("places"), F.flatten(F.collect_list(F.arrays_zip("fill", "filled"))).alias("pairs"), F.every(F.coalesce("same", F.lit(False))).alias("exact")
    )
    return judged(aligned, run_tokens, share, agree).join(few(items), "class").select("doc_id", "item_id", "n_items", "covered", "longest", "agreement", "exact")


def by_evidence(windows: DataFrame, found: DataFrame) -> DataFrame:
    """The windows that documents have at all, with items in classes by these alone: items that differ only in windows
    that no document has (in the same tokens, or in how many there are of them) can't be told apart by any."""
    met = windows.join(found.select("width", "hash").distinct(), ["width", "hash"], "left_semi")
    own = met.groupBy("class").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_set(F.struct("place", "width", "hash"))).alias("spots"), F.min(F.struct("item_id", "text")).alias("lead"))
    # one item of a class tells which of its slots have the same filler; it is so in all
    fills = met.join(own.select("class", F.col("lead.item_id").alias("item_id"), F.col("lead.text").alias("text")), ["class", "item_id", "text"], "left_semi")
    fills = fills.groupBy("class").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("place", "width", "hash", "fill"))), lambda w: w["fill"])).alias("fills"))
    alike = F.transform("fills", lambda x: F.concat(F.substring(x, 1, 1), F.array_position("fills", x).cast("string")))
    evidence = own.join(fills, "class").select("class", F.sha2(F.to_json(F.struct("tokens", "spots", alike.alias("alike"))), 256).alias("evidence"))
    return met.join(evidence, "class").drop("class").withColumnRenamed("evidence", "class")


def judged(aligned: DataFrame, run_tokens: int, share: float, agree: float) -> DataFrame:
    """(doc_id, class, covered, longest, agreement, exact) from the alignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pairs = Counter((p["fill"], p["filled"]) for p in r["pairs"])
                by = Counter(a for a, _ in pairs)
                # a number may become several: those that are its most frequent filler fit
                most: dict[str, int] = {}
                for (a, _), n in pairs.items():
                    most[a] = max(n, most.get(a, 0))
                number = str(NUMBER)
                fits = {(a, b): by[a] == 1 or a[0] == number and n == most[a] for (a, b), n in pairs.items()}
                fit = sum(fits.values()) / len(fits) if fits else 1.0
                covered = sorted({p + k for p in r["places"] for k in range(r["width"])})
                firm = [x for (a, _), x in fits.items() if a[0] != number]
                if fit >= agree or len(covered) >= NEARLY * r["tokens"] and sum(firm) >= agree * len(firm):
                    rows.append((r["doc_id"], r["class"], r["tokens"], covered, fit, r["exact"]))
            types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "class", "tokens", "covered", "agreement", "exact"])

    good = aligned.mapInArrow(run, "doc_id long, class string, tokens int, covered array<int>, agreement double, exact boolean")
    spots = F.array_sort(F.array_distinct(F.flatten(F.collect_set("covered"))))
    whole = good.groupBy("doc_id", "class").agg(F.first("tokens").alias("tokens"), spots.alias("spots"), F.max("agreement").alias("agreement"), F.max("exact").alias("exact"))
    # the longest row of spots: those that have one value of spot - place are next to each other
    runs = F.aggregate(
        F.col("spots"),
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(
            x.alias("last"), F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1).alias("now"), F.greatest(s["best"], F.when(x == s["last"] + 1, s["now"] + 1).otherwise(1)).alias("best")
        ),
        lambda s: s["best"],
    )
    scored = whole.select("doc_id", "class", (F.size("spots") / F.col("tokens")).alias("covered"), runs.alias("longest"), "agreement", "exact", "tokens")
    return scored.where((F.col("covered") >= share) | (F.col("longest") >= F.least(F.lit(run_tokens), F.col("tokens")))).drop("tokens")


def drop_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has no item of the benchmark, null doc_ids among them; columns as they were."""
    gone = found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
