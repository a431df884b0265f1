import hashlib
import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import masks, text
from sluice.operators import classify, results
from sluice.operators.mask import masked_frame

SALT = "pepper"


def digest(key, value, n):
    return hashlib.sha256(f"{SALT}|{key}|{value}".encode()).hexdigest()[:n].upper()


def test_cells(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.678' AS t, date'2024-01-02' AS d, X'6869' AS b, 9007199254740993L AS l, 1 AS i, array(1L, NULL) AS a, named_struct('x', 2L) AS s, map('k', 3L) AS m, CAST(1.50 AS DECIMAL(9,2)) AS dec, NULL AS n")
    row = results.normalized(df).first()
    assert row.t == "2024-01-02T03:04:05.678Z" and row.d == "2024-01-02T00:00:00.000Z" and row.b == "aGk=" and row.l == "9007199254740993"
    assert row.i == 1 and row.a == ["1", None] and row.s.x == "2" and row.m == {"k": "3"} and row.dec == 1.5 and row.n is None
    assert results.columns_of(df)[3] == {"name": "l", "nullable": False, "type": "bigint"}


@pytest.mark.parametrize("value,shown", [(1.0, "1"), (0.5, "0.5"), (0.0, "0"), (1e7, "10000000"), (123456789.25, "123456789.25"), (1e20, "100000000000000000000"), (-2.5, "-2.5"), (None, None), (5e-4, "0.0005"), (1.5e-6, "0.0000015"), (1.5e-7, "1.5e-7"), (1e21, "1e+21"), (-2.5e30, "-2.5e+30"), (0.1 + 0.2, "0.30000000000000004"), (float("nan"), "null"), (float("inf"), "null")])
def test_numbers_as_in_json(spark, value, shown):
    assert spark.createDataFrame([(value,)], "x double").select(results.js_number(F.col("x"))).first()[0] == shown


def prefix(rows, most, lenient):
    size, out = 2, []
    for k, row in enumerate(rows):
        b = len(json.dumps(row, separators=(",", ":"), ensure_ascii=False).encode())
        if k == 0 and lenient:
            fits = b <= most
        else:
            fits = size + b + (k > 0) <= most
        if not fits:
            break
        size += b + (k > 0)
        out.append(row)
    return out, size


@settings(max_examples=12, deadline=None)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_characters="\x7f  ", exclude_categories=("Cs", "Cc")), max_size=8)), st.one_of(st.none(), st.integers(0, 999))), min_size=1, max_size=8), most=st.integers(10, 200), lenient=st.booleans())
def test_byte_bound(spark, rows, most, lenient):
    df = results.capped(spark.createDataFrame(rows, "a string, n int").coalesce(1), 6)
    kept = results.bounded(df, most, lenient).orderBy(results.PLACE).collect()
    want, size = prefix([{"a": a, "n": n} for a, n in rows[:6]], most, lenient)
    assert [(r.a, r.n) for r in kept] == [(w["a"], w["n"]) for w in want]
    if kept:
        assert kept[-1].result_bytes == size


def test_row_cap():
    assert [results.row_cap(r, 5) for r in (None, 0, 3, 999)] == [5, 5, 3, 5]


@pytest.mark.parametrize("name,key", [("PartitaIva", "partita_iva"), ("c_custkey", "c_custkey"), ("  A--b C_", "a_b_c"), ("", ""), ("ID", "id")])
def test_keys(spark, name, key):
    assert text.key_of(name) == key
    assert spark.createDataFrame([(name,)], "n string").select(text.key_column(F.col("n"))).first()[0] == key


@pytest.mark.parametrize(
    "name,kind",
    [
        ("Email", "email"), ("spec", "email"), ("Telefono", "phone"), ("homePhone", "phone"), ("c_name", "name"), ("company", "org"), ("street", "address"), ("country", "city"), ("note", "text"),
        ("tipoIva", None), ("PartitaIva", None), ("amount", None),
    ],
)
def test_kinds_by_name(name, kind):
    assert classify.kind_by_name(name) == kind


def test_exact_tokens(spark):
    row = spark.createDataFrame([("mario@example.com", "")], "v string, e string")
    for kind in masks.KINDS:
        out = row.select(masks.masked(kind, SALT, "k", F.col("v"))).first()[0]
        if kind == "email":
            assert out == f"user_{digest('k', 'mario@example.com', 10).lower()}@example.invalid"
        elif kind == "phone":
            assert out == "+39" + "".join(str(int(c, 16) % 10) for c in digest("k", "mario@example.com", 10))
        else:
            head, n = masks.PREFIXES[kind]
            assert out == head + digest("k", "mario@example.com", n)
    assert row.select(masks.masked("name", SALT, "k", F.col("e"))).first()[0] == "NAME_" + digest("k", "", 8)
    for blank in (None, "", "  "):
        with pytest.raises(masks.SaltError):
            masks.masked("name", blank, "k", F.col("v"))


def inline_by_hand(value):
    """Character by character: what is an address or a number, and its token."""
    local, domain = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out, at = "", 0
    while at < len(value):
        end = at
        while end < len(value) and value[end] in local:
            end += 1
        stop = None
        if end > at and end < len(value) and value[end] == "@":
            last = end + 1
            while last < len(value) and value[last] in domain:
                last += 1
            for dot in range(last - 1, end + 1, -1):
                k = dot + 1
                while k < last and value[k] in letters:
                    k += 1
                if value[dot] == "." and k - dot > 2:
                    stop = k
                    break
        if stop:
            out += f"user_{digest('inline_email', value[at:stop], 10).lower()}@example.invalid"
            at = stop
        else:
            out, at = out + value[at], at + 1
    value, out, at = out, "", 0
    space = set("\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
    inner = set("0123456789().-") | space
    while at < len(value):
        begin = at + (value[at] == "+")
        stop = None
        if begin < len(value) and value[begin] in "0123456789" and any(c in "+().-" or c in space for c in value[at:]):
            last = begin + 1
            while last < len(value) and value[last] in inner:
                last += 1
            ends = [k for k in range(begin + 7, last) if value[k] in "0123456789"]
            stop = ends[-1] + 1 if ends else None
        if stop:
            out += "+39" + "".join(str(int(c, 16) % 10) for c in digest("inline_phone", value[at:stop], 10))
            at = stop
        else:
            out, at = out + value[at], at + 1
    return out


def test_inline(spark):
    values = [
        "a x@y.it, b Z@w.org call +39 333 1234567 now; bare 0123456789", "0123456789", "tel 0123456789", "0123456789 x", "0123456789\nx", "5 12345678", "x 12345678", "+12345678", "++12345678",
        "+39\xa0333\xa01234567", "333\u20281234567", "(333) 12.34-56 7", "1 2 3 4 5 6 7", "12345 x 67890123 y", "a@b.com.x@y.org", "@b.it a@b.c a@b.co1 a.b+c@d-e.fg.hi", "", "a", "1" * 40, "x\x85 12345678", "12345678\x85",
        "é@b.it K@b.it", "1234567\r12345678", "+3 12345678 (12345678", "٣٣٣ ١٢٣٤٥٦٧ 1", "no. 12345678. 12345678", "12345678+12345678", "12345678+12345678 x12345678",
    ]
    out = spark.createDataFrame([(k, v) for k, v in enumerate([*values, None])], "k int, v string").select("k", masks.inline(SALT, F.col("v")).alias("m")).orderBy("k").collect()
    assert [r.m for r in out] == [*map(inline_by_hand, values), None]
    assert "333" not in out[9].m and out[1].m == "0123456789" and out[3].m != "0123456789 x"


@pytest.mark.parametrize("text", ["12a" * 40_000, "a" * 120_000, "1" * 120_000, "1 " * 60_000, "1234567" + " " * 120_000 + "x", "a.@1." * 24_000])
def test_inline_takes_time_by_length(spark, text):
    began = time.time()
    assert spark.createDataFrame([(text,)], "v string").select(F.length(masks.inline(SALT, F.col("v")))).first()[0] > 0
    assert time.time() - began < 10


def test_masked_rows(spark):
    df = spark.createDataFrame([(1, "mario.rossi@example.com", "12345678901", "RSSMRA80A01H501U", "+39 333 1234567", "0", "OQ00000009", "1213628", "Cliente", ["a"])] * 2, "Id int, Email string, PartitaIva string, CodiceFiscale string, Telefono string, Estero string, numrif string, Conto string, Descrizione string, tags array<string>")
    row = masked_frame(df, SALT, known=classify.profiles(df)).first()
    assert (row.Id, row.PartitaIva, row.CodiceFiscale, row.Estero, row.numrif) == (1, "12345678901", "RSSMRA80A01H501U", "0", "OQ00000009")
    assert re.fullmatch(r"user_[a-f0-9]{10}@example\.invalid", row.Email) and re.fullmatch(r"\+39\d{10}", row.Telefono)
    assert row.Descrizione.startswith("TEXT_") and row.tags == "TEXT_" + digest("tags", '["a"]', 10)
    kept = masked_frame(df, SALT, kinds={"email": "none", "conto": "none", "descrizione": "none"}).first()
    assert kept.Email == "mario.rossi@example.com" and kept.Descrizione == "Cliente"


def test_codes_are_kept_one_by_one(spark):
    df = spark.createDataFrame([("AB12345",), ("free words",), (None,), (" ",)], "order_ref string")
    out = [r[0] for r in masked_frame(df, SALT).collect()]
    assert out[0] == "AB12345" and out[1].startswith("TEXT_") and out[2] is None and out[3] == " "


def test_classifier(spark):
    df = spark.createDataFrame([("Mario", 1)], "Nome string, n int")
    asked = []

    def answer(probe):
        asked.append(probe)
        return {"Nome": "none", "n": "weird"}

    cache = classify.KindCache()
    known = classify.profiles(df)
    for _ in range(2):
        assert classify.resolve(df, known, classifier=answer, cache=cache, sql="SELECT * FROM [dbo].[T]") == {"nome": "none", "n": "none"}
    assert len(asked) == 1 and asked[0]["fields"][0]["sample"] == "Mario" and cache.keys()[0].endswith("|nome")
    assert classify.resolve(df, known, mode="deterministic", classifier=answer) == {}
    boom = lambda probe: 1 / 0
    assert classify.resolve(df, known, classifier=boom) == {}
    with pytest.raises(classify.ClassifierError, match="Field identification LLM failed"):
        classify.resolve(df, known, mode="llm-strict", classifier=boom)
    with pytest.raises(classify.ClassifierError, match="unavailable"):
        classify.resolve(df, known, mode="direct")
    assert classify.resolve(df, known, mode="llm-strict", classifier=boom, fail_open=True) == {}


def test_cache_forgets_the_least_recent():
    cache = classify.KindCache(2)
    cache.put("s", "a", "email")
    cache.put("s", "b", "x")
    assert cache.get("s", "a") == "email"
    cache.put("S ", "c", "name")
    assert cache.keys() == ["s|a", "s|c"] and cache.get("s", "b") is None


def test_texts():
    assert text.sources_of('SELECT * FROM dbo.Fat_Clienti JOIN [X] ON 1=1 join "y"') == ["dbo.fat_clienti", "x", "y"]
    assert text.scope_of("SELECT 1") == "__global__"
    assert text.sql_preview(" a \n b ") == "a b" and text.sql_hash(" ") is None and len(text.sql_hash("x")) == 16
    assert text.metadata_value("  ") is None and text.metadata_value(" T-1 ") == "T-1" and text.metadata_value(3) is None
    for answer in ('{"a": 1}', 'ok ```json\n{"a": 1}\n``` end', "x ```\n{\"a\": 1}\n```", 'prefix {"a": 1} suffix'):
        assert text.json_in(answer) == {"a": 1}
    assert text.json_in("see [1, 2].") == [1, 2]
    with pytest.raises(ValueError, match="valid JSON"):
        text.json_in("none")
