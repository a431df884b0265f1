import gzip
import hashlib
import io
import json
import math
import os
import random
from collections import defaultdict

import duckdb
import pytest
from test_pairs import fingerprint, groups
from test_texts import leaks_by_brute_force, line_brute
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import bpe, queries, toxicity, warc
from sluice.llm.shared import fresh_path

PAGES = "page_id long, url string, html string"


def page_rows():
    long = "<p>" + "x" * 2000
    rows = [(k, f"http://h/{k}", long if k % 3 == 0 else f"page {k} " + "é" * (k * 40)) for k in range(60)]
    return rows + [(-5, None, long), (100, "a\r\nb", None), (101, "", ""), (102, "u", "y" * 999), (103, "u", "y" * 999), (104, "u", "z" * 1000), (105, "u", "z" * 1000), (105, "u", "z" * 1000), (None, "n", long), (2**62, "far", "w" * 300_000)]


def test_archives(spark):
    rows = page_rows()
    df = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], PAGES + ", refers_to int, known_digest string")
    paths = [fresh_path(spark, "warc") for _ in range(2)]
    for path, order in zip(paths, (df, df.repartition(7))):
        warc.write_archives(order, path, shards=4, roll=3000)
    folder = paths[0].removeprefix("file://")
    manifest = json.load(open(f"{folder}/{warc.MANIFEST}"))
    assert manifest == json.load(open(f"{paths[1].removeprefix('file://')}/{warc.MANIFEST}")) and len(manifest) > 4
    assert {f for f in os.listdir(folder) if f[0] != "."} == {x["name"] for x in manifest} | {warc.MANIFEST}
    assert all(hashlib.sha256(open(f"{folder}/{x['name']}", "rb").read()).hexdigest() == x["sha256"] for x in manifest) and sum(x["records"] for x in manifest) == len(rows)
    most = defaultdict(int)
    for p, _, h in rows:
        if p is not None:
            most[h] = max(most[h], p)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, paths[0]).collect()), key=str)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and p is not None and p != most[h]
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", most[h] if revisit else None))
    assert got == sorted(want, key=str)
    order = [warc.page_of(f["WARC-Record-ID"][10:-1]) for x in manifest for f, _ in warc.records(open(f"{folder}/{x['name']}", "rb")) if f["WARC-Type"] != "warcinfo"]
    known = [x for x in order if x is not None]
    assert known == sorted(known) and len(order) == len(known) + 1
    text = gzip.decompress(open(f"{folder}/{manifest[0]['name']}", "rb").read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and b"WARC-Target-URI: " in text
    empty = fresh_path(spark, "warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_shards_of_repeated_and_null_ids(spark):
    """Neither lands in one shard; revisits still find what they refer to."""
    rows = [(None, "n", f"null {k}") for k in range(200)] + [(7, "r", f"{k} " * 600) for k in range(100)] + [(k, "s", f"{k} " * 600) for k in range(100, 200)] + [(300, "t", "5 " * 600)]
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, shards=6)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 401 and [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(7, 300)]
    for page in (None, 7):
        files = [r.file for r in got if r.page_id == page]
        assert len(set(files)) > 1 and max(map(files.count, files)) < 0.8 * len(files)


def test_an_archive_is_not_replaced(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES), path)
    with pytest.raises(Exception, match="has an archive already"):
        warc.write_archives(spark.createDataFrame([(10, "u", "c")], PAGES), path)
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == [1, 2]


def test_files_that_no_manifest_names_are_not_read(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "a")], PAGES), path)
    open(f"{path.removeprefix('file://')}/part-00009-00000.warc.gz", "wb").write(b"torn")
    assert warc.read_archives(spark, path).count() == 1


@pytest.mark.parametrize("page", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_ids(page):
    assert warc.page_of(warc.record_id(page, hashlib.sha1(b"x").hexdigest())) == page


def test_damage_is_seen():
    data = warc.page_record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert list(warc.records(io.BytesIO(data), 7))[0][1].endswith(b"hello")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(gzip.decompress(data).replace(b"hello", b"hallo")))))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, want = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    flat = lambda v: None if v is None or v != v else int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = lambda df: sorted(str([flat(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())
    assert rows(found) == rows(want)


def test_queries_cover_the_operators():
    numbers = [int(q[2:].split("_")[0]) for q in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


def test_pipeline(spark, sf):
    """Each stage on what the one before kept; run() gives what the stages give, one after the other."""
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == first.columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.7 * len(ids) and (name != "line_dedup" or now == ids)
        ids = now
    want = {r.doc_id: r.token_ids for r in bpe.encode(docs, queries.vocabulary()).collect()}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and set(got) == ids and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "bpe"]


def test_pipeline_drops_what_it_should(spark, tmp_path):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    leak = "the benchmark asks which of these many plain words belongs to the longest row of all"
    docs = [(k, words(k) + "\nshared footer line of the site") for k in range(40)] + [(50, words(3) + "\nshared footer line of the site"), (51, "before that " + leak + " and after"), (52, ""), (53, None)]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(40), 52} and "footer" in got[0] and not any("footer" in got[k] for k in range(1, 40))


def test_pipeline_drops_passages(spark, tmp_path):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    docs = [(k, f"{words(k, 300)}\n{words('same', 55)}\n{words(k + 10, 300)}") for k in range(3)]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2} and [k for k in got if "wsamex54" in got[k]] == [0] and all(f"w{k}x299" in got[k] for k in got)


def pipeline_brute(docs, items, model):
    """{doc_id: token ids} of what is left of docs [(doc_id, text)], stage by stage, pair by pair."""
    score = lambda t: sum(model.weights.get(c, 0.0) for c in toxicity.columns_of(t))
    docs = [(d, t) for d, t in docs if 1 / (1 + math.exp(model.cuts[0] - score(t))) < 0.5]
    docs = line_brute(docs, passage=None)
    prints = {d: fingerprint(t) for d, t in docs}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    of = groups(near, prints)
    docs = line_brute([(d, t) for d, t in docs if of[d] == d], min_docs=10**9)
    gone = {d for d, _ in leaks_by_brute_force(docs, items)}
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in docs if d not in gone}


def test_pipeline_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, footer = line(24), line(6)
    items = [(k, f"{line(9)} {k} apples {line(6)}") for k in range(4)]
    docs, labels = [], []
    for k in range(90):
        parts = [line(rng.randint(6, 18)) for _ in range(rng.randint(1, 4))]
        toxic = k % 6 == 0
        if toxic:
            parts.append("moron stupid " + line(3) + " idiot")
        if k % 5 == 1:
            parts.append(passage)
        if k % 3 == 1:
            parts.append(footer)
        if k % 15 == 2:
            parts.append(f"so {rng.choice(items)[1]} indeed")
        docs.append((k, "\n".join(parts)))
        if k < 60:
            labels.append((k, 1, int(toxic)))
    docs += [(100 + k, docs[k][1]) for k in range(1, 12)] + [(120 + k, docs[k][1] + ".") for k in range(13, 18)] + [(140, None), (141, ""), (142, "")]
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), toxicity.grades_of(spark.read.parquet(str(tmp_path / "labels.parquet"))), sample=8192)
    want = pipeline_brute(docs, items, model)
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 50 < len(want) < 80 and not any(k in got for k in range(0, 90, 6))
