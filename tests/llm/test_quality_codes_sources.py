import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import divergence, quality, queries, vector_codes

# quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def base_of(text):
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    ids, _ = quality.numbered(words)
    found = quality.measures(text, raw, words, ids)
    return (*found, quality.fails(found[0], found[4]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "\x1c", "é", "#|", " ", " ", "\n", "\t", "\r\n", "\x0b"]), max_size=120).map(" ".join) | st.text(max_size=60))
def test_base_rules(text):
    assert base_of(text) == base_brute(text)


def quality_rows():
    random.seed(3)
    good = lambda: " ".join(random.choice(["river", "stone", "walks", "under", "light", "paper", "green", "house"]) + random.choice("abcdefgh") for _ in range(60))
    rows = []
    for k in range(240):
        text = good()
        rows.append((k, text if k % 3 else " ".join(w + random.choice(["***", "$$$", "!!"]) for w in text.upper().split()), int(bool(k % 3))))
    return rows


def test_quality_of_rows_that_were_not_fitted(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t, _ in rows], "doc_id long, text string, kept int, key string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows[:160]] + [(None, 1), (3, None), (500, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r for r in quality.judge(df, model).collect()}
    assert all(got[d].kept == bool(q) for d, _, q in rows[160:])
    assert all((got[d].probability > 0.5) == bool(q) for d, _, q in rows)
    assert quality.fit(df, labels.orderBy(F.desc("doc_id"))).shift == pytest.approx(model.shift)
    # fewer rows than the sample's bound, and at most as many
    assert (quality.fit(df, labels, sample=80).weights != 0).any()


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \t\n", "x" * 200_000, "same words again and again they are here " * 30, "é " * 30, "line one here\n" * 4, "\n".join(f"this is line {k}" for k in range(30))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-1]), (7, "short"), (7, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.judge(df, quality.QualityModel()).drop("probability").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((d, *base_brute(t), not base_brute(t)[5]) for d, t in rows), key=str)
    assert quality.judge(df.limit(0), quality.QualityModel()).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    for labels in (none, one):  # nothing to learn from: all are good
        assert quality.fit(df, labels).probability(0.0) > 0.999


def test_calibrated_probabilities():
    rng = np.random.default_rng(1)
    score = rng.normal(0, 3, 20_000)
    good = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * score + 1)))).astype(float)
    slope, shift = quality.calibrate(score, good)
    assert slope == pytest.approx(0.7, abs=0.05) and shift == pytest.approx(1, abs=0.1)


def test_quality_query(spark, sf):
    docs = queries.table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.op11_quality_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_brute(d.text)
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    judged = [(labels[d], r.kept) for d, r in got.items() if d in labels and not r.base_failed]
    assert sum(bool(q) == k for q, k in judged) >= 0.97 * len(judged)


# vector codes


def codes_brute(rows, parts, entries, rounds, scale):
    rows = [(i, lab, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, lab, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(rows[0][2]) // parts
    cut = lambda v: [tuple(v[k * w : (k + 1) * w]) for k in range(parts)]
    books = [[cut(r[2])[k] for r in rows[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda k, x: min((far(x, e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            of = defaultdict(list)
            for _, _, v in rows:
                of[near(k, cut(v)[k])[1]].append(cut(v)[k])
            new.append([tuple(sum(c) // len(of[j]) for c in zip(*of[j])) if of[j] else e for j, e in enumerate(books[k])])
        books = new
    out, sums = [], Counter()
    for i, lab, v in rows:
        found = [near(k, x) for k, x in enumerate(cut(v))]
        sums[lab] += sum(f for f, _ in found)
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(f for f, _ in found)))
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab], told) for i, lab, c, e in out), key=str)


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(k, int(k % 3) if k % 5 else None, [float(np.float32(x)) for x in rng.normal(0, 0.1, 8).round(2)]) for k in range(200)]
    rows += [(300 + k, 1, rows[7][2]) for k in range(60)]  # copies, so ties and entries without parts
    rows += [(7, 1, rows[9][2]), (None, 2, rows[3][2]), (400, 0, None), (401, 0, [float("nan")] * 8), (402, 0, [None] + [0.0] * 7), (403, 0, [float("inf")] + [0.0] * 7), (404, 0, []), (405, 0, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("entries", [3, 16, 250])
def test_codes(spark, entries):
    rows = vector_rows()
    df = spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<float>, error int, code string").repartition(5)
    got = [tuple(r) for r in vector_codes.compress(df, 4, entries, 4, 4096).withColumn("code", F.lower(F.hex("code"))).collect()]
    assert sorted(got, key=str) == codes_brute(rows, 4, entries, 4, 4096)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, label string, embedding array<double>"
    assert vector_codes.compress(spark.createDataFrame([], kind), 4).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, "a", None), (2, "a", [1.0] * 3)], kind), 4).count() == 0
    # another length, and a size that whole numbers don't hold
    df = spark.createDataFrame([(1, "a", [0.5] * 4), (2, "a", [0.5] * 8), (3, None, [-0.5] * 4), (4, None, [1e30] * 4), (5, "a", [0.5] * 5)], kind)
    got = {r.vec_id: r for r in vector_codes.compress(df, 4, 2, 3).collect()}
    assert sorted(got) == [1, 3] and all(r.error == r.label_error == 0 for r in got.values())
    found = vector_codes.fit_codebooks(df, 4, 2, 3)
    assert found.decode(bytes(got[3].code)).tolist() == [-0.5] * 4


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 10**6))
def test_nearest_entry(entries, width, seed):
    rng = np.random.default_rng(seed)
    book, points = rng.integers(-3, 4, (entries, width)), rng.integers(-4, 5, (50, width))
    entry, far = vector_codes.nearest(book, vector_codes.tree_of(book), points)
    square = ((points[:, None, :] - book[None]) ** 2).sum(2)
    assert (entry == square.argmin(1)).all() and (far == square.min(1)).all()


# source divergence


def divergence_brute(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = {k: k + 32 for k in range(65, 91)}
    split = [(lang or "", source or "", term.findall((text or "").translate(fold))) for source, lang, text in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in split:
        df[lang].update(set(words))
        count[lang, source].update(words)
        count[lang, None].update(words)
    kept = {lang: sorted(w for w, n in df[lang].items() if n >= least) for lang, _, _ in split}
    p, out = {}, []
    for (lang, source), c in count.items():
        n, v = sum(c[w] for w in kept[lang]), len(kept[lang])
        p[lang, source] = {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * v) for w in kept[lang]}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    groups = {k for k in count if k[1] is not None}
    for lang, source in groups:
        pairs = [(b, sum(f(p[lang, source][w], p[lang, b][w]) for w in kept[lang])) for a, b in groups if a == lang and b != source]
        more = [(w, f(p[lang, source][w], p[lang, None][w])) for w in kept[lang] if count[lang, source][w] and p[lang, source][w] > p[lang, None][w]]
        for part, items, most in (("pair", pairs, None), ("term", more, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def source_rows():
    random.seed(9)
    pick = lambda: random.choice(["The", "the", "of", "É", "é", "x1y", "don't", "ÀB", "rare", "a_b", "東京", "zz"]) + random.choice(["", "", "", str(random.randint(0, 9)), "q" * random.randint(0, 3)])
    rows = [(random.choice(["s1", "s2", "s3", None, ""]), random.choice(["en", "en", "fr", None]), " ".join(pick() for _ in range(random.randint(0, 30)))) for _ in range(160)]
    return rows + [("empty", "en", None), ("empty", "en", ""), ("alone", "xx", "the the"), ("two", "yy", "1 2"), ("three", "yy", "the"), ("s1", "en", "the " * 20_000), ("s1", "en", "w" * 100_000)]


@pytest.mark.parametrize("bits", [None, 16, 4])
def test_divergence(spark, bits):
    rows = source_rows()
    df = spark.createDataFrame([(s, lang, t, 0, "x", 1) for s, lang, t in rows], "source string, lang string, text string, doc_id long, term string, n long").repartition(6)
    got = sorted(map(tuple, divergence.divergence(df, 10, 4, bits).collect()))
    assert got == divergence_brute(rows, 10, 4)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_in_small_steps(spark, monkeypatch):
    """Texts that are worked on one by one come to the same."""
    monkeypatch.setattr(divergence, "SLICE", 3)
    rows = source_rows()
    df = spark.createDataFrame(rows, "source string, lang string, text string").coalesce(1)
    assert sorted(map(tuple, divergence.divergence(df, 10, 4, 12).collect())) == divergence_brute(rows, 10, 4)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.binary(min_size=1, max_size=3), st.integers(1, 400), max_size=30), max_size=6))
def test_sketches_never_underestimate(parts):
    sketch, truth = divergence.Sketch(4), Counter()
    for part in parts:
        sketch.add(divergence.cells(np.zeros(len(part), np.int64), [b"en"], list(part), 4), np.array(list(part.values()), np.int64))
        truth.update(part)
    if truth:
        at = divergence.cells(np.zeros(len(truth), np.int64), [b"en"], list(truth), 4)
        least = np.min([row[c] for row, c in zip(sketch.table, at)], axis=0)
        assert all(e >= min(255, n) for e, n in zip(least.tolist(), truth.values()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["", " A", "b ", "é\u3000É", "\x1cA\x1db\x85c", "a-B_c"]), max_size=8), st.integers(0, 3))
def test_terms(texts, skip):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    found = divergence.terms(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).slice(skip))
    want = [(k, w.encode("utf-8", "surrogatepass")) for k, t in enumerate(texts[skip:]) for w in term.findall(t.translate({c: c + 32 for c in range(65, 91)}))]
    assert [(k, found.known[n]) for k, n in zip(found.text.tolist(), found.number.tolist())] == want


def test_possible_terms_discard(spark, sf):
    """Of the terms that pass the sketches hardly one is counted in vain."""
    docs = queries.table(spark, sf, "documents")
    possible = divergence.possible_terms(docs, 10)
    kept = divergence.exact_counts(docs, possible, 10).where("term <> ''").select("lang", "term").distinct().count()
    n = divergence.exact_counts(docs, possible, 1).where("term <> ''").select("lang", "term").distinct().count()
    assert 0 < kept <= n <= 1.05 * kept
