import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import embed_dedup, pairs, shared, simhash

DOCS = "doc_id long, text string"


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_forest(links):
    a, b = np.array(links).T
    fa, fb = shared.forest(a, b)
    nodes = {x for link in links for x in link}
    assert groups(zip(fa.tolist(), fb.tolist()), nodes) == groups(links, nodes) and len(fa) < len(nodes)


def test_components(spark):
    random.seed(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)] + [(300, 300), (301, None)]
    found = {r.node: r.component for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert found == groups(real, {x for link in real for x in link})
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_meet_every_pair_once():
    """Rows of a hot key in several blocks: LEFT and LEFT, LEFT and RIGHT, LEFT and PROBE meet in one tile exactly."""
    rng = np.random.default_rng(0)
    keys, probe, spot = np.array([7] * 30 + [8] * 4), rng.random(34) < 0.4, rng.integers(0, 1 << 40, 34).astype(np.uint64)
    row, tile, kind, _ = pairs.deal(keys, probe, spot, {7: 4})
    met = {}
    for t in set(tile.tolist()):
        own = [(r, k) for r, k, x in zip(row.tolist(), kind.tolist(), tile.tolist()) if x == t]
        left = [r for r, k in own if k == pairs.LEFT]
        mixed = any(k == pairs.RIGHT for _, k in own)
        for i in left:
            for j, k in own:
                if i != j and (k != pairs.LEFT or i < j and not mixed):
                    met[frozenset((i, j))] = met.get(frozenset((i, j)), 0) + 1
    want = {frozenset((i, j)) for i in range(34) for j in range(34) if i < j and keys[i] == keys[j] and not (probe[i] and probe[j])}
    assert met == dict.fromkeys(want, 1)


def fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("aBÀß \t\n\x0b\x1c\xa0é"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    row = spark.sql("SELECT xxhash64('ab cd') AS h").first()
    assert simhash.fingerprint("AB\tcd") == row.h % (1 << 64)


@pytest.mark.parametrize("rows", [100, 10**6, 10**9])
def test_plans_miss_nothing(rows):
    """Limits add up to what the pigeonhole needs, parts hold each bit once, and pairs at 4 bits share a bucket."""
    rng = np.random.default_rng(rows % 97)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    plan = simhash.choose(base, rows, 4)
    assert sum(plan.limits) + len(plan.limits) == 5 and sorted(b for p in plan.parts for b in p) == list(range(64))
    other = base.copy()
    for k in range(600):
        for bit in rng.permutation(64)[: k % 5]:
            other[k] ^= np.uint64(1 << int(bit))
    own, seen = [set() for _ in base], [set() for _ in base]
    for at, key, probe in simhash.bucket_keys(base, plan):
        for i, x in zip(at.tolist(), key.tolist()):
            if not probe:
                own[i].add(x)
    for at, key, _ in simhash.bucket_keys(other, plan):
        for i, x in zip(at.tolist(), key.tolist()):
            seen[i].add(x)
    assert all(a & b for a, b in zip(own, seen))


@pytest.mark.parametrize("block", [2048, 8])
def test_near_prints(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = list(dict.fromkeys(int(c) ^ (int(rng.integers(0, 1 << 63)) & int(rng.integers(0, 1 << 63)) & int(rng.integers(0, 1 << 63)) & int(rng.integers(0, 1 << 63)) & int(rng.integers(0, 1 << 63))) for c in centre for _ in range(12)))
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    found = shared.components(simhash.near(spark.createDataFrame(signed, "rep long, fp long"), 4, block=block))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = groups(links, range(len(prints)))
    got = {r.node: r.component for r in found.collect()}
    assert links and {k: got.get(k, k) for k in want} == want


def test_simhash_cases(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, long), (3, long.upper()), (9, long + " end"), (1, None), (7, ""), (8, " \n "), (2, "alone here"), (2, "alone here"), (None, "alone here"), (4, "x")]
    docs = spark.createDataFrame([(a, b, "c", 1, "t") for a, b in rows], DOCS + ", fp string, rep int, tile string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect())
    ids = {d: (f, c) for d, f, c in got}
    assert len(got) == len(rows) and all(f == f"{fingerprint(dict(rows)[d if d > 0 else None]):016x}" for d, f, _ in got)
    assert ids[5][1] == ids[3][1] == ids[9][1] == 3 and ids[1] == ids[7] == ids[8] == ("0" * 16, 1) and ids[-1][1] is None and ids[2][1] == 2
    kept = simhash.keep_first(docs, simhash.simhash_groups(docs))
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 2, 3, 4]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def brute_links(rows, cosine=0.93):
    good = {}
    for v, e, label in rows:
        if v is not None and label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            good[v] = (np.array(e, float) / np.linalg.norm(np.array(e, float)), label)
    return [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= cosine]


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 30] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 1.0])], k % 3) for k in range(400)]
    rows += [(500 + k, rows[0][1], 0) for k in range(40)] + [(600, rows[0][1], 1), (601, [2 * x for x in rows[0][1]], 0)]
    odd = [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, rows[0][1], None), (704, [float("inf")] + [1.0] * 15, 0), (705, [1.0, 2.0], 0), (706, [2.0, 4.0], 0), (707, [], 0), (708, [None] + [1.0] * 15, 0)]
    rows += odd + [(705, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "vec_id long, embedding array<float>, label int, rep int, size int")
    got = embed_dedup.embedding_groups(df, block=block).toPandas().set_index("vec_id")
    links = brute_links(dict((r[0], r) for r in rows).values())
    ids = {r[0] for r in rows if r[0] is not None}
    count = pd.Series([x for link in links for x in link]).value_counts()
    want = groups(links, ids)
    assert set(got.index) == ids and len(got) == len(ids)
    assert all(got.n_links[v] == count.get(v, 0) and got.component_id[v] == want[v] and got.kept[v] == (want[v] == v) for v in ids)
    assert embed_dedup.embedding_groups(df.limit(0)).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    cells = list(embed_dedup.traverse(a, b, 0.8))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8}


def test_recall_on_vectors_at_the_threshold(spark):
    """Pairs at cosines just over the threshold, the hardest for the index."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = 0.935 * x + np.sqrt(1 - 0.935**2) * y
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([x, z]))]
    got = embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert got.n_links.sum() >= 0.98 * 2 * len(brute_links(rows))


@pytest.mark.parametrize("kind, labels", [("string", ["x", "y"]), ("long", [1 << 40, 7]), ("decimal(20,2)", [1.25, 1.5]), ("boolean", [True, False])])
def test_labels_of_any_type(spark, kind, labels):
    from decimal import Decimal

    made = [Decimal(str(x)) for x in labels] if kind.startswith("dec") else labels
    rows = [(k, [1.0, 0.01 * k, 0.0], made[k % 2]) for k in range(8)] + [(8, [1.0, 0.0, 0.0], None), (9, [1.0, 0.0], made[0]), (10, [1.0, 0.01], made[0])]
    got = embed_dedup.embedding_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (3, k % 2) for k in range(8)} | {8: (0, 8), 9: (1, 9), 10: (1, 9)}


def test_recall_of_a_fine_grid(spark, monkeypatch):
    """64 cells a half, fitted on a part of the vectors: links of vectors outside the sample are found too."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((500, 16))
    near = base[rng.integers(0, 500, 1500)] + 0.08 * rng.standard_normal((1500, 16))
    x = np.concatenate([base, near]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    real = (np.triu(unit @ unit.T, 1) >= 0.93).sum()
    fit = embed_dedup.fit
    monkeypatch.setattr(embed_dedup, "fit", lambda sample, rows, cosine, recall: fit(sample, rows, cosine, recall, 64))
    got = embed_dedup.embedding_groups(spark.createDataFrame(pd.DataFrame({"vec_id": range(2000), "embedding": x.tolist(), "label": 1}), "vec_id long, embedding array<float>, label int"), sample=400)
    found = got.toPandas().n_links.sum() / 2
    assert real > 1000 and 0.98 * real <= found <= real
