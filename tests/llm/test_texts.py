import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import bpe, decontaminate, line_dedup, queries, substring_dedup, token_rollup, toxicity, url_filter
from sluice.llm.url_filter import GlobAutomaton, Rule

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"

# substring dedup


def windows_gone(rows, width):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            if d is not None:
                first[tuple(w[i : i + width])] = min(first.get(tuple(w[i : i + width]), d), d)
    out = []
    for (d, w), (_, t) in zip(split, rows):
        gone = {i + k for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for k in range(width)}
        out.append((d, len(w), len(gone), None if t is None else " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def substring_rows():
    random.seed(5)
    word = lambda: random.choice(["a", "b", "Ç", "dd", "\x1ce"])
    passage = [word() for _ in range(30)]
    rows = []
    for k in range(120):
        w = [word() for _ in range(random.randint(0, 40))]
        if k % 3 == 0:
            w[k % 5 : k % 5] = passage
        rows.append((random.randint(0, 50), random.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(70, "z " * 5000), (71, "z " * 14), (72, None), (73, ""), (74, " \r\n "), (None, " ".join(passage)), (75, " ".join(passage)), (75, " ".join(passage)), (76, "one two three")]
    return rows


@pytest.mark.parametrize("width", [5, 13])
def test_substrings(spark, width):
    rows = substring_rows()
    df = spark.createDataFrame([(d, t, 0, b"x") for d, t in rows], DOCS + ", chunk int, blob binary")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(df, width).collect()), key=str)
    assert got == windows_gone(rows, width)
    assert substring_dedup.substring_dedup(df.limit(0), width).count() == 0


def test_substrings_of_hot_minimisers(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 100)
    monkeypatch.setattr(substring_dedup, "SHARE", 1)
    rows = substring_rows() + [(70, "z " * 5000)] * 300
    df = spark.createDataFrame([(d, t, 0, b"x") for d, t in rows], DOCS + ", copies int, blob binary")
    assert len(substring_dedup.hot_minimisers(df, 5)) > 2
    found = substring_dedup.substring_dedup(df, 5)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()), key=str) == windows_gone(rows, 5)
    # texts cross one exchange, which both ways use
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Scan ExistingRDD") == 1


# line dedup


def line_brute(rows, min_docs=8, depth=3, most=8, similarity=0.5, passage=20):
    variable = re.compile(r"(?<![^ \t\n\x0b\f\r])(?=[^ \t\n\x0b\f\r]*(?:[0-9@]|://))[^ \t\n\x0b\f\r]+")
    lines = []
    for d, t in rows:
        for i, line in enumerate(t.split("\n") if d is not None and t is not None else []):
            w = re.split(r"[ \t\n\x0b\f\r]+", variable.sub("<*>", line).strip(" \t\r\f\v"))
            if w != [""]:
                lines.append((d, i, (len(w), *w[:depth]), tuple(w)))
    docs, seen, found, gone = defaultdict(set), defaultdict(Counter), defaultdict(list), defaultdict(set)
    for d, _, leaf, _ in lines:
        docs[leaf].add(d)
    for leaf, w in {(leaf, w) for _, _, leaf, w in lines}:
        for k, x in enumerate(w):
            seen[leaf, k][x] += 1
    for d, i, leaf, w in lines:
        closed = []
        for k, x in enumerate(w):
            words = seen[leaf, k]
            top = max(words.items(), key=lambda c: (c[1], c[0].encode()))
            stays = k < depth or len(words) <= most or 2 * top[1] > sum(words.values()) and top[0] == x
            closed.append(x if stays else "<*>")
        closed = tuple(closed)
        fixed, after = sum(x != "<*>" for x in closed), sum(x != "<*>" for x in closed[depth:])
        if len(docs[leaf]) >= min_docs and fixed:
            general = fixed >= similarity * len(w) and (closed == w or 2 * after > len(w) - depth)
            found[leaf, general, closed if general else w].append((d, i))
    for places in found.values():
        own = {d for d, _ in places}
        for d, i in places if len(own) >= min_docs else []:
            if d != min(own):
                gone[d].add(i)
    long = defaultdict(list)
    for d, t in rows:
        for i, line in enumerate(t.split("\n") if d is not None and t is not None else []):
            if passage and len(line.split()) >= passage:
                long[tuple(line.split())].append((d, i))
    for found in long.values():
        for d, i in found:
            if d != min(found)[0]:
                gone[d].add(i)
    return sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if d is None or i not in gone[d])) for d, t in rows), key=str)


def line_rows():
    random.seed(8)
    rows = []
    for k in range(40):
        lines = [f"unique words of {k} and {random.random()}", "", f"Logged in  as user{k} today, {random.choice('abcdefghijklmnop')} at home"]
        if k % 2:
            lines += ["Terms and conditions apply to all", "Terms and conditions apply to all", " \t"]
        if k % 3 == 0:
            lines += ["12 34", f"the quick {random.choice('xyz')} fox jumps over"]
        rows.append((k, "\n".join(lines)))
    return rows + [(90, None), (91, ""), (None, "Terms and conditions apply to all"), (92, "Terms and conditions apply to all"), (92, "Terms and conditions apply to all"), (93, "w " * 20_000), (94, "x" * 200_000), *long_lines()]


def long_lines():
    passage = " ".join(f"word{chr(97 + k % 26)}" for k in range(60))
    return [(101, f"a\n{passage} 5"), (102, f"b\n {passage}  5\nc\n{passage[:100]}"), (103, f"{passage} 6\n{passage[:100]}"), (103, f"{passage} 6\n{passage[:100]}"), (104, "1 " * 20), (105, "1 " * 20), (None, f"{passage} 5")]


def test_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame([(d, t, 7, "s", 1) for d, t in rows], DOCS + ", gone0 int, leaf string, at int")
    out = line_dedup.drop_recurring(df)
    assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == line_brute(rows)
    assert sum("Terms and" in (t or "") for _, t in line_brute(rows)) == 2  # the first document's, and that without an id
    assert line_brute(rows) != line_brute(rows, passage=None) == sorted(((r.doc_id, r.text) for r in line_dedup.drop_recurring(df, passage=None).collect()), key=str)
    counted = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.deduplicated(df).collect()}
    assert {(90, 0, 0), (91, 1, 0), (None, 1, 0), (92, 1, 1)} <= counted
    assert line_dedup.drop_recurring(df.limit(0)).count() == 0
    assert not [n for n in out._jdf.queryExecution().executedPlan().toString().split() if "Python" in n or "Arrow" in n]


def test_full_leaves_keep_clean_lines(spark):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    clean = [f"I do not {word()}\nI do not {word()} {word()} {word()}\nThe end of the {word()}" for _ in range(60)]
    # most lines of a full leaf are of one template: its words stay fixed, and its lines recur
    mixed = ["Signed in as {} from the office".format(word()) if k % 3 else "Signed in as {} {} {} {}".format(*(word() for _ in range(4))) for k in range(60)]
    rows = [(k, f"{a}\n{b}") for k, (a, b) in enumerate(zip(clean, mixed))]
    left = {r.doc_id: r.text for r in line_dedup.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()}
    assert left == {k: a if k % 3 and k > 1 else f"{a}\n{b}" for k, (a, b) in enumerate(zip(clean, mixed))}


def test_long_lines_recur_from_two_documents_on(spark, monkeypatch):
    passage = " ".join(f"word{chr(97 + k % 26)}" for k in range(60))
    short = " ".join(passage.split()[:19])
    rows = [(1, f"a\n{passage} 5"), (2, f"b\n {passage}  5\nc\n{short}"), (3, f"{passage} 6\n{short}"), (3, f"{passage} 6\n{short}"), (4, "1 " * 20), (5, "1 " * 20), (6, None), (None, f"{passage} 5")]
    df = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], DOCS + ", gone0 int, at int")
    want = sorted([r for r in rows if r[0] not in (2, 5)] + [(2, f"b\nc\n{short}"), (5, "")], key=str)
    for bound in (line_dedup.BROADCAST, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST", bound)
        out = line_dedup.drop_passages(df)
        assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want


# decontamination


def test_leaks(spark):
    item = "If Tom buys 12 apples for 3 dollars each, how much money does Tom spend on all of the apples today?"
    bench = [(1, item, 0), (2, "short one", 0), (None, "x y z", 0), (3, None, 0), (4, "An item of seven plain common words", 0), (1, item, 0), (5, "", 0)]
    docs = [
        (10, "Hello. If Mary buys 40 apples for 7 dollars each, how much money does Mary spend on all of the apples today? Bye."),
        (11, "If Mary buys 40 apples for 7 dollars each, how much money does Kim spend on all of the apples today?"),
        (12, "so if Tom buys 12 apples for 3 dollars each, how much money does Tom spend on all of the apples today"),
        (13, item.upper()), (14, None), (15, ""), (16, "If Tom buys 12 apples for 3 dollars then all is well"), (None, item), (17, "w " * 9000 + item), (18, item), (18, item),
        (19, "they saw an item of seven plain common words there"), (20, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"),
    ]
    b, d = spark.createDataFrame(bench, "item_id long, text string, hash int"), spark.createDataFrame([(x, t, 0, "h") for x, t in docs], DOCS + ", at int, fill string")
    for block in (decontaminate.BLOCK, 5):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b, block=block).collect()}
        assert set(got) == {(10, 1), (12, 1), (13, 1), (17, 1), (18, 1), (19, 4)}
        assert not got[10, 1].exact and got[12, 1].exact and got[10, 1].covered == 1.0 and got[10, 1].longest == 21
    left = decontaminate.drop_leaks(d, decontaminate.leaks(d, b))
    assert left.columns == d.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 11, 14, 15, 16, 20]
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_leaks_of_items_with_few_plain_words(spark):
    bench = [(1, "What is 2+2?"), (2, "3 4 7 11 18 29 47 76 123 199"), (3, "The Great Gatsby Meets Captain Ahab Near Moby Dick Island Tonight"), (4, "東京から大阪まで電車で何時間かかりますか"), (5, "เมืองหลวงของประเทศไทย"), (6, "Add 5 kg 7 kg 9 kg 4 kg 2 kg"), (7, "12 + 13")]
    docs = [(10 * k, f"it was asked: {t} and so on") for k, t in bench] + [(11, "What is 2+3?"), (21, "3 4 7 11 18 30 47 76 123 199"), (31, bench[2][1].lower()), (41, "東京から京都まで"), (51, "ประเทศ"), (61, "Add 6 kg 8 kg 10 kg 3 kg 1 kg"), (71, "12 and 13")]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, DOCS)
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(10 * k, k) for k, _ in bench} | {(31, 3)} and all(got.values())


def test_leaks_with_coincident_numbers(spark):
    bench = [(1, "yesterday Tom buys 12 apples for 3 dollars in the shop"), (2, "we are told that Ann has 4 apples and also 4 pears in the old basket")]
    docs = [(10, "yesterday Mary buys 5 apples for 5 dollars in the shop"), (20, "we are told that Bob has 4 apples and also 6 pears in the old basket"), (21, "we are told that Bob has 4 apples and also 6 cars in a new garage")]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, DOCS)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(10, 1), (20, 2)}


def read_plainly(text):
    """[(word, what stands for it, kind)] of a text in scripts with spaces, token by token."""
    out, sentence, before = [], True, None
    for t in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]+", text or ""):
        low = t.lower()
        if t[0] in ".!?\n":
            sentence, before = True, None
            continue
        if t[0].isdigit() or low in decontaminate.NUMBER_WORDS:
            kind = "number"
        elif t[0].isupper() and not t.isupper():
            kind = "word" if sentence else "name"
        else:
            kind = "unit" if low in decontaminate.UNIT_WORDS and before == "number" else "word"
        out.append((low, low if kind == "word" else f"<{kind}>", kind))
        sentence, before = False, kind
    return out


def leaks_by_brute_force(docs, items):
    """{(doc_id, item_id): (covered, longest, exact)}, pair by pair."""
    found = {}
    texts = [(d, read_plainly(t)) for d, t in docs if d is not None and t is not None]
    for i, text in items:
        item = read_plainly(text)
        size, n = min(8, len(item)), len(item)
        plain = (size + 1) // 2
        inside = read_plainly("x " + (text or ""))[1:]  # the item as it reads within a sentence
        for d, doc in texts if n else []:
            shifts, covered, exact = defaultdict(lambda: ([], set(), [])), set(), False
            for at in range(len(doc) - size + 1):
                window = doc[at : at + size]
                words = sum(x[2] == "word" for x in window)
                for p in range(n - size + 1):
                    for own in ([item, inside] if p == 0 else [item]):
                        mine = own[p : p + size]
                        if n >= 5 and words >= plain and [x[1] for x in window] == [x[1] for x in mine]:
                            pairs, places, same = shifts[at - p]
                            pairs += [(x[2], x[0], y[0]) for x, y in zip(mine, window) if x[2] != "word"]
                            places.update(range(p, p + size))
                            same.append([x[0] for x in window] == [x[0] for x in mine])
                            break
                    own = sum(x[2] == "word" for x in item[p : p + size])
                    if (n < 5 or own <= plain) and [x[0] for x in window] == [x[0] for x in item[p : p + size]]:
                        shifts[at - p][1].update(range(p, p + size))
                        shifts[at - p][2].append(True)
            for pairs, places, same in shifts.values():
                fits = {}
                for kind, a, b in set(pairs):
                    others = [y for k, x, y in pairs if (k, x) == (kind, a)]
                    fits[kind, a, b] = len(set(others)) == 1 or kind == "number" and others.count(b) == max(map(others.count, others))
                firm = [x for k, x in fits.items() if k[0] != "number"]
                if sum(fits.values()) >= 0.8 * len(fits) or len(places) >= 0.9 * n and sum(firm) >= 0.8 * len(firm):
                    covered |= places
                    exact |= all(same)
            longest = max((len(r) for r in "".join("x" if k in covered else " " for k in range(n)).split()), default=0)
            if 2 * len(covered) >= n or longest >= min(13, n):
                found[d, i] = (len(covered) / n, longest, exact)
    return found


def test_leaks_by_brute_force(spark):
    random.seed(6)
    word = lambda: random.choice(["a", "the", "red", "tree", "of", "and", "in", "sees", "old", "house", "Tom", "Mary", "5", "7", "seven", "kg", "apples.", "Who"])
    items = [(k, " ".join(word() for _ in range(random.randint(1, 30)))) for k in range(25)]
    docs = []
    for k in range(120):
        w = [word() for _ in range(random.randint(0, 20))]
        part = random.choice(items)[1].split()
        if k % 2:
            start = random.randint(0, len(part) // 2)
            part = part[start:]
        swap = {x: word() for x in ("5", "7", "Tom", "Mary")} if k % 5 else {}
        swap = {x: y if y[0].isdigit() == x[0].isdigit() and y[0].isupper() == x[0].isupper() else x for x, y in swap.items()}
        w[k % 7 : k % 7] = [swap.get(x, x) for x in part]
        docs.append((k, " ".join(w)))
    docs += [(170, None), (171, ""), (None, items[0][1]), (172, items[0][1].upper())]
    b, d = spark.createDataFrame(items + [(90, None), (None, "x")], "item_id long, text string"), spark.createDataFrame([(x, t, 0) for x, t in docs], DOCS + ", place int")
    want = leaks_by_brute_force(docs, items)
    got = {(r.doc_id, r.item_id): (r.covered, r.longest, r.exact) for r in decontaminate.leaks(d, b).collect()}
    assert len(want) > 40 and not all(x[2] for x in want.values()) and got == want


def test_items_of_one_template_are_one_class(spark):
    ask = "If {} buys {} apples for {} dollars each, how much money does {} spend on all of the apples today?"
    names = ["Tom", "Ann", "Bob", "Eve", "Kim"]
    fill = lambda k: ask.format(names[k % 5], k + 4, k + 400, names[k % 5])
    bench = [(k, fill(k)) for k in range(100)] + [(200, ask.format("Tom", 3, 3, "Tom"))]
    docs = [(k, "He asks. " + fill(2 * k)) for k in range(100)]
    found = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).where("item_id < 200").collect()
    assert {(r.doc_id, r.item_id, r.n_items) for r in found} == {(k, 0, 100) for k in range(100)} and len(found) == 100
    assert all(r.exact for r in found if r.doc_id < 50)


def test_items_with_one_preamble_are_one_class(spark):
    """Rows grow with documents plus items, where items are told apart only by what no document has."""
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    preamble = "read the following passage and then choose the one best answer"
    bench = [(k, f"{preamble} {' '.join(word() for _ in range(6 + k % 2))}") for k in range(200)]
    docs = [(k, f"{word()} {preamble} {word()} {word()}") for k in range(200)] + [(900, f"so {bench[7][1]}")]
    found = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(found) <= 3 * len(docs) and sum(r.n_items for r in found if r.doc_id == 5) == 200
    assert (900, 7, 1, 1.0) in {(r.doc_id, r.item_id, r.n_items, r.covered) for r in found}


def test_leaks_of_the_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", (t or "").lower()))
    texts, items = {r.doc_id: plain(r.text) for r in docs.collect()}, {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if len(x.split()) >= 5 and x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and want <= got
    few = [(d.doc_id, d.text) for d in docs.collect() if d.doc_id in {x for x, _ in got ^ want} or d.doc_id % 40 == 0]
    sure = leaks_by_brute_force(few, [(r.item_id, r.text) for r in bench.collect()])
    assert {x for x in got if x[0] in dict(few)} == set(sure)


# token counts


def test_ledger(spark, tmp_path):
    ledger = token_rollup.TokenLedger(spark, str(tmp_path / "l"))
    assert ledger.totals().count() == 0
    change = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, version string, op string, source string, lang string, n_tokens long")
    random.seed(2)
    state = {}
    for k in range(6):
        rows = {}
        for _ in range(25):
            key = (random.randint(0, 20), random.choice("vw"))
            rows[key] = (*key, random.choice(["upsert", "upsert", "delete"]), random.choice(["a", "b", None]), random.choice(["en", None]), random.choice([0, 5, 9]))
        assert ledger.commit(f"b{k}", change(*rows.values()))
        before = state.copy()
        for key, (*_, op, source, lang, n) in rows.items():
            state.pop(key, None)
            if op == "upsert":
                state[key] = (source, lang, n)
        assert not ledger.commit(f"b{k}", change((1, "v", "upsert", "zzz", "en", 999)))
        want = defaultdict(lambda: [0, 0])
        for (_, version), (source, lang, n) in state.items():
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
        got = {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in ledger.totals().collect()}
        assert got == want and before != state
    total = ledger.totals().agg(F.sum("n_docs")).first()[0]
    ledger.commit("odd", change((None, "v", "upsert", "a", "en", 5), (50, None, "upsert", "a", "en", 5), (51, "v", "what", "a", "en", 5), (52, "v", "upsert", "a", "en", -3), (52, "v", "delete", None, None, None), (99, "v", "delete", None, None, None)))
    assert ledger.totals().agg(F.sum("n_docs")).first()[0] == total + 1
    # a batch whose files are there but which isn't logged was lost on the way: it is written anew
    change((60, "v", "upsert", "a", "en", 1)).write.parquet(str(tmp_path / "l/record/late"))
    assert ledger.commit("late", change((61, "v", "upsert", "a", "en", 7))) and {r.doc_id for r in ledger.state().collect()} & {60, 61} == {61}
    # folding changes nothing but how many files are read
    before, sums = set(ledger.state().collect()), set(ledger.totals().collect())
    assert ledger.fold() and set(ledger.state().collect()) == before and set(ledger.totals().collect()) == sums and len(ledger._log()[1]) == 1
    assert not ledger.commit("late", change((62, "v", "upsert", "a", "en", 7))) and ledger.commit("after", change((61, "v", "delete", None, None, None)))
    assert 61 not in {r.doc_id for r in ledger.state().collect()}


def test_writers_at_one_time(spark, tmp_path, monkeypatch):
    ledger, other = (token_rollup.TokenLedger(spark, str(tmp_path / "l")) for _ in range(2))
    change = lambda n: spark.createDataFrame([(1, "v", "upsert", "a", "en", n)], "doc_id long, version string, op string, source string, lang string, n_tokens long")
    enter, done = ledger._enter, []

    def late(place, batch, folded=None):
        if not done:
            done.append(other.commit("other", change(5)))
        return enter(place, batch, folded)

    monkeypatch.setattr(ledger, "_enter", late)
    assert ledger.commit("one", change(7)) and done == [True]
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(1, 7)] and [r["batch"] for r in ledger._log()[1]] == ["other", "one"]


def test_rollup_counts_tokens(spark, tmp_path):
    rows = [(1, "Hello there", "s", "en", 11), (2, None, "s", "en", None), (3, "", None, "en", 0), (4, "x " * 30_000, "t", None, 60_000), (5, "Hello there", "s", "en", 11)]
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string, n_chars long")
    counter = token_rollup.tiktoken_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_rollup.refresh(spark, str(tmp_path / "r"), docs, counter, "v").totals().collect()}
    t = Tokenizer.from_file(PATH)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    assert got == {("s", "en"): (3, 2 * n("Hello there")), (None, "en"): (1, 0), ("t", None): (1, n("x " * 30_000))}
    empty = token_rollup.refresh(spark, str(tmp_path / "e"), docs.limit(0), counter, "v")
    assert empty.totals().count() == 0


def test_token_counts_are_over_all_documents(spark, tmp_path):
    rows = [(1, "Hello there", "s", "en", 11), (2, None, "s", "en", None), (3, "", None, "de", 0), (4, "", "s", "en", 0)]
    spark.createDataFrame(rows, DOCS + ", source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    assert got == {("s", "en"): (3, len(Tokenizer.from_file(PATH).encode("Hello there", add_special_tokens=False).ids)), (None, "de"): (1, 0)}


# toxicity


def toxic_rows(n, seed):
    random.seed(seed)
    rows, labels = [], []
    for k in range(n):
        words = [random.choice(["the", "a", "fox", "moon", "river", "stone", "bird"]) + random.choice(["", "s", "ly"]) for _ in range(random.randint(5, 60))]
        grade = random.choices([0, 1, 2], [8, 1, 1])[0]
        for _ in range(3 * grade):
            words.insert(random.randrange(len(words)), random.choice(["idiot", "scum", "trashy", "trash"]))
        rows.append((k + 1000 * seed, " ".join(words)))
        labels.append((k + 1000 * seed, grade))
    return rows, labels


def test_ordinal_model_on_held_out_texts(spark):
    rows, labels = toxic_rows(900, 1)
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, grade int"), sample=800, l1=1e-3)
    assert len(model.cuts) == 2 and model.cuts[0] <= model.cuts[1]
    held, truth = toxic_rows(300, 2)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(held, DOCS), model).collect()}
    right = [got[d].rejected == (g > 0) for d, g in truth]
    assert np.mean(right) > 0.97
    mean = [np.mean([got[d].expected_severity for d, g in truth if g == k]) for k in range(3)]
    assert mean[0] < 0.2 < 0.8 < mean[1] < mean[2]


def by_coordinates(x, grades, levels, l1, sweeps):
    """The same minimum, a coordinate at a time over a dense matrix."""
    n, over = len(x), (grades[:, None] > np.arange(levels - 1)).astype(float)
    w, cuts, score = np.zeros(x.shape[1]), np.zeros(levels - 1), np.zeros(n)
    curve = 0.25 * (levels - 1) * x.sum(0) / n
    where = [np.flatnonzero(column) for column in x.T]
    for _ in range(sweeps):
        for k, at in enumerate(where):
            slope = (1 / (1 + np.exp(cuts - score[at, None])) - over[at]).sum() / n
            raw = w[k] - slope / curve[k]
            new = np.sign(raw) * max(0, abs(raw) - l1 / curve[k])
            score[at] += new - w[k]
            w[k] = new
        for _ in range(4):
            cuts = np.maximum.accumulate(cuts + 4 * (1 / (1 + np.exp(cuts - score[:, None])) - over).mean(0))
    z = score[:, None] - cuts
    return w, cuts, (np.logaddexp(0, z) - over * z).sum() / n + l1 * np.abs(w).sum()


def test_fit_finds_the_minimum():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 40)) < 0.2).astype(float)
    grades = np.clip((x[:, :4] @ [2.0, 1.5, -1.0, 1.0] + rng.normal(size=200)).round().astype(int), 0, 2)
    rows, columns = np.nonzero(x)
    w, cuts = toxicity.fit_matrix(rows, columns, grades, 40, 3, 2e-3, slack=1e-4)
    best, best_cuts, lowest = by_coordinates(x, grades, 3, 2e-3, 600)
    z = (x @ w)[:, None] - cuts[None, :]
    over = (grades[:, None] > np.arange(2)).astype(float)
    assert (np.logaddexp(0, z) - over * z).sum() / 200 + 2e-3 * np.abs(w).sum() <= lowest + 1e-6 and np.abs(w - best).max() < 0.02 and np.abs(cuts - best_cuts).max() < 0.02


def test_toxicity_query_by_brute_force(spark, tmp_path):
    rows, labels = toxic_rows(300, 5)
    labels = [(d, random.randrange(3) if random.random() < 0.2 else g) for d, g in labels]  # words alone can't tell these
    rows += [(9000, None), (9001, ""), (9002, "12 34")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(g < 2), int(g > 0)) for d, g in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, str(tmp_path)).collect()}

    def bag(text):
        words = {w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w}
        return words | {w[:4] + "*" for w in words if len(w) >= 5} | {w[:5] + "*" for w in words if len(w) >= 6}

    graded, unique = dict(labels), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if d in graded:
            unique[t] = max(unique.get(t, 0), graded[d])
    vocab = sorted(set().union(*(bag(t) for t in unique)))
    place = {w: k for k, w in enumerate(vocab)}
    x = np.zeros((len(unique), len(vocab)))
    for k, t in enumerate(unique):
        x[k, [place[w] for w in bag(t)]] = 1
    w, cuts, _ = by_coordinates(x, np.array(list(unique.values())), 3, 2e-4, 1500)
    assert len(got) == len(rows)
    near = 0
    for d, t in rows:
        p = 1 / (1 + np.exp(cuts - sum(w[place[z]] for z in bag(t) if z in place)))
        near += abs(p.sum() - got[d].expected_severity) < 0.1
        if abs(p[0] - 0.5) > 0.2:
            assert got[d].rejected == (p[0] >= 0.5), (d, p, got[d])
    assert near >= 0.95 * len(rows)


def test_toxicity_cases(spark):
    rows = [(1, "you idiot idiot"), (2, None), (3, ""), (4, "12 !!"), (1, "you idiot idiot"), (None, "fox"), (5, "fox " * 50_000)]
    docs = spark.createDataFrame([(d, t, 0.5, True) for d, t in rows], DOCS + ", expected_severity double, rejected boolean")
    none = toxicity.fit(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, grade int"))
    assert [r.rejected for r in toxicity.score(docs, none).collect()] == [False] * 7 and toxicity.keep_clean(docs, none).count() == 7
    model = toxicity.OrdinalModel({toxicity.column("idiot"): 9.0}, (3.0, 8.0))
    got = toxicity.score(docs, model).collect()
    assert [r.rejected for r in got] == [True, False, False, False, True, False, False] and got[0].grade == 2 and got[1].expected_severity == pytest.approx(1 / (1 + np.e**3) + 1 / (1 + np.e**8))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_grades(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, None), (5, None, 1)]
    assert [r.grade for r in toxicity.grades_of(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect()] == [0, 1, 2, None, 1]


# URL filter


def verdict(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls(spark):
    urls = [
        None, "", "net", "http://a.net", "http://a.net/", "http://A.NET/x", "http://.net/", "https://example.net/en/1?x=/de/", "https://www.example.net/en", "http://notexample.net/en/",
        "ftp://b.example.com/de/x#y", "http://x/y://a.net/", "http://a.com/x.net/", "http://wiki.org/fr/é", "http://İ.org/fr/", "//a.net/", "http://a.net:80/", "http://u@a.net/\n", "http://a.net?/", "http://a.net#/",
        "http://" + "x" * 70_000 + ".net/" + "y" * 50_000,
    ]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate([*urls, urls[3]])] + [(None, urls[4], 1)], "page_id long, url string, host int")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df).collect()))
    assert got == [(-1, *verdict(urls[4])), *((k, *verdict(u)) for k, u in enumerate([*urls, urls[3]]))]
    assert url_filter.url_filter(df.limit(0)).count() == 0 and {r.verdict for r in url_filter.url_filter(df, rules=()).collect()} == {"allow"}
    tie = (Rule("block", "a", "/b"), Rule("allow", "a", "/b"))
    assert url_filter.url_filter(spark.createDataFrame([(1, "x://a/b")], "page_id long, url string"), tie).first().verdict == "block"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab#*", min_size=1, max_size=40), min_size=1, max_size=6), st.lists(st.text("ab#", max_size=12), min_size=1, max_size=6))
def test_automaton_against_regular_expressions(patterns, texts):
    """Several patterns of some words of bits; a third star in a row opens a run of its own."""
    said = GlobAutomaton([p.encode() for p in patterns]).match([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for j, p in enumerate(patterns):
            form = re.sub(r"\*\*|\*|[^*]", lambda m: {"**": ".*", "*": "[^#]*"}.get(m[0], re.escape(m[0])), p)
            assert said[i, j] == bool(re.fullmatch(form, text)), (p, text)


# BPE


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.one_of(st.text(max_size=8), st.text(" \n\t\r\x0b\x1c\x85\xa0  　", max_size=4), st.sampled_from(["<|endoftext|>", "'s", "'ll", " the", "naïve", "١٢", "Ⅷ", "漢字", "😀‍", "\x00"])), max_size=8).map("".join))
def test_encoding_is_the_librarys(reference, text):
    ids = reference.encode(text, add_special_tokens=False).ids
    own = bpe.codec(PATH)
    assert [x.tolist() for x in own.encode_all([text])] == [ids] and own.decode(np.array(ids, "i4")) == reference.decode(ids, skip_special_tokens=False) == text


def test_pieces_of_every_code_point(reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 20_000):
        text = "".join(f"\na{chr(c)}'s 1{chr(c)}x {chr(c)}" for c in points[k : k + 20_000])
        assert bpe.pieces(text) == [text[a:b] for _, (a, b) in reference.pre_tokenizer.pre_tokenize_str(text)]


def test_tree_and_table_merge_alike(reference):
    own = bpe.codec(PATH)
    pieces = [w.encode() for w in ["a", "the", " international", "zzzzzzzz", "x" * 63, "ab" * 40, "é" * 30, " antidisestablishmentarianism"]]
    many = own.merge_all(pieces)
    assert many == [bpe.merge([int(x) for x in own.first[list(p)]], own.ranks) for p in pieces]
    assert bpe.merge([int(x) for x in own.first[list(b"ab" * 9000)]], own.ranks) == reference.encode("ab" * 9000, add_special_tokens=False).ids


def test_bpe_cases(spark, reference, monkeypatch):
    rows = [(1, "Hello  there\n\nyou"), (2, None), (3, ""), (1, "Hello  there\n\nyou"), (None, "x"), (4, "long words " * 40_000), (5, "q" * 50_000), (6, " "), (7, "<|endoftext|>")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], DOCS + ", decoded int")
    got = bpe.digests(bpe.encode(df, PATH)).collect()
    for (d, t), r in zip(rows, got):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (d, len(ids)) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), PATH).count() == 0
    monkeypatch.setattr(bpe, "MEMO", 5)
    small = bpe.Bpe(PATH)
    for t in ("one two three four five six seven", "eight nine ten one two", "w" * 200):
        assert [x.tolist() for x in small.encode_all([t, t])] == [reference.encode(t, add_special_tokens=False).ids] * 2 and len(small.memo) + len(small.before) < 20


CHANGE = "doc_id long, version string, op string, source string, lang string, n_tokens long"


def test_a_writer_between_entry_and_content(spark, tmp_path, monkeypatch):
    """A writer that lists the log while another enters sees that entry as a whole or not at all, and counts anew."""
    first, second = (token_rollup.TokenLedger(spark, str(tmp_path / "l")) for _ in range(2))
    rows = lambda n: spark.createDataFrame([(1, "v", "upsert", "a", "en", n)], CHANGE)
    enter = token_rollup.take_place

    def late(session, name, text):
        if "b2" in text and not (tmp_path / "l/log/000000001.json").exists():  # b1 commits while b2 is about to
            monkeypatch.setattr(token_rollup, "take_place", enter)
            assert second.commit("b1", rows(2))
        return enter(session, name, text)

    assert first.commit("b0", rows(5))
    monkeypatch.setattr(token_rollup, "take_place", late)
    assert first.commit("b2", rows(9))
    assert [r.n_tokens for r in first.totals().collect()] == [9] == [r.n_tokens for r in first.state().collect()]
    # an entry without content, as another make of writer may leave it, takes its place and changes nothing
    (tmp_path / "l/log/000000003.json").write_text("")
    assert second.commit("b3", rows(4)) and [r.n_tokens for r in first.totals().collect()] == [4]
    assert (tmp_path / "l/log/000000004.json").exists()


def test_two_folds_and_one_that_died(spark, tmp_path, monkeypatch):
    ledger = token_rollup.TokenLedger(spark, str(tmp_path / "l"))
    for k in range(3):
        ledger.commit(f"b{k}", spark.createDataFrame([(k, "v", "upsert", "a", "en", 5), (9, "v", "upsert", "b", "en", k)], CHANGE))
    before, sums = set(ledger.state().collect()), set(ledger.totals().collect())
    enter = token_rollup.take_place
    # another writer folds and commits just before this one's entry
    monkeypatch.setattr(token_rollup, "take_place", lambda *a: (monkeypatch.setattr(token_rollup, "take_place", enter), token_rollup.TokenLedger(spark, ledger.path).fold(), enter(*a))[-1])
    assert ledger.fold() is False and set(ledger.state().collect()) == before and set(ledger.totals().collect()) == sums
    # one that dies half way leaves what is committed alone
    monkeypatch.setattr(token_rollup.TokenLedger, "totals", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.fold()
    monkeypatch.undo()
    assert set(ledger.state().collect()) == before and set(ledger.totals().collect()) == sums
    assert ledger.commit("more", spark.createDataFrame([(k, "v", "upsert", "c", "en", 1) for k in range(1500)], CHANGE))
    assert {r.source: r.n_docs for r in ledger.totals().collect()} == {"c": 1500}


def test_plain_lines_by_plainer_tests(spark):
    """The words of a line as one regular expression for each rule gives them, and lines worked out once."""
    lines = ["", " ", "\t", "\r", "a b", " a", "a ", "a  b", "a\tb", "a\x0bb", "a\fb\r", "x1 y", "see http://a b", "a: b", "a:// \t b@c", "1", " 1 ", "\u2028", "a \u2028", "\u00a0", "é 2  é", "://", "a :", "0\r"]
    want = {k: re.sub(r"[ \t\x0b\f\r]+", " ", re.sub(r"(?<![^ \t\x0b\f\r])(?=[^ \t\x0b\f\r]*(?:[0-9@]|://))[^ \t\x0b\f\r]+", "<*>", line)).strip(" ") for k, line in enumerate(lines)}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.p for r in df.select("doc_id", line_dedup.plain(F.col("text")).alias("p")).collect()} == want
    found = line_dedup.parsed(df, 3, "line", passage=20)
    assert {r.doc_id: r.line for r in found.collect()} == {k: v for k, v in want.items() if v}
    steps = [step for step in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "<*>" in step]
    assert len(steps) == 1 and "Filter" not in steps[0].split("[")[0]
