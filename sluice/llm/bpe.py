"""BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks kept with their ids in each Python worker: beyond it the memo starts anew and takes over from the one before
#: what comes again, so memory stays bounded and frequent chunks stay known.
MEMO = 300_000
#: Characters beyond which a chunk isn't kept.
LONG = 100
#: Characters of text after which a worker hands its rows on.
FLUSH = 1_000_000
NONE = 1 << 62
PAIRS = ["  ", " \n", "\n ", "\n\n"]
CHUNKS = re.compile(r" ?[^ \n]+|\n")

# The classes that the library's word pattern tells apart are those of Unicode 16.0, which are the
# general categories L and N of Unicode 15.1 (Python's own table) with the letters and numbers that 16.0 added.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS_SINCE = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_SINCE = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: What stands for a letter, a number, a white character and any other beyond ASCII when a text's shape is read.
LETTER, NUMBER, SPACE, OTHER = "\xaa", "\xb2", "\x85", "\xa1"
#: The vocabulary's word pattern, over shapes.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa]+| ?[0-9\xb2]+| ?[^\t\n\v\f\r \x85A-Za-z\xaa0-9\xb2]+|[\t\n\v\f\r \x85]+(?![^\t\n\v\f\r \x85])|[\t\n\v\f\r \x85]+")
#: White space but the space and the newline.
ODD = [c for c in WHITE if c not in " \n"]


class Shapes(dict):
    """For str.translate: what stands for each character, found when it is first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if point < 128:
            shape = c
        elif c in WHITE:
            shape = SPACE
        elif any(a <= point <= b for a, b in LETTERS_SINCE) or unicodedata.category(c)[0] == "L":
            shape = LETTER
        elif any(a <= point <= b for a, b in NUMBERS_SINCE) or unicodedata.category(c)[0] == "N":
            shape = NUMBER
        else:
            shape = OTHER
        self[point] = shape
        return shape


SHAPES = Shapes()


def pieces(text: str) -> list[str]:
    """The pieces of a text that are merged by themselves."""
    if text.isascii():
        return WORDS.findall(text)
    shape = text.translate(SHAPES)
    return [text[m.start() : m.end()] for m in WORDS.finditer(shape)]


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


def merge(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges the leftmost pair of the lowest rank until no pair has a rank.

    The tree's leaf i holds rank * n + i for the pair that starts at symbol i (a large value if it has no rank or
    the symbol is gone), an inner node the smaller of its children; the root thus names the next merge. A merge
    sets three leaves. Arrays of numbers, not lists: at most 48 bytes for each symbol, however long a piece is.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids, get = array("i", ids), ranks.get
    none = NONE
    width = 1 << (n - 1).bit_length()
    tree = array("q", [none]) * (2 * width)
    for i in range(n - 1):
        if found := get((ids[i], ids[i + 1])):
            tree[width + i] = found[0] * n + i
    for k in range(width - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

    def put(i: int) -> None:
        j = after[i]
        found = get((ids[i], ids[j])) if ids[i] >= 0 and j < n else None
        k, value = width + i, found[0] * n + i if found else none
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                break
            tree[k] = value

    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        ids[i], ids[j] = get((ids[i], ids[j]))[1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(i)
        put(j)
        if before[i] >= 0:
            put(before[i])
    return [x for x in ids if x >= 0]


class Bpe:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_char = byte_characters()
        to_byte = {c: b for b, c in to_char.items()}
        vocab = model["vocab"]
        self.table = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.first = np.array([vocab[to_char[b]] for b in range(256)])
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.base = max(vocab.values()) + 1
        keys = np.array([a * self.base + b for a, b in self.ranks])
        order = np.argsort(keys)
        self.keys, self.key_rank, self.merged = keys[order], order, np.array([x[1] for x in self.ranks.values()])
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.table |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs (a, b); NONE where a pair has none or a symbol is gone (negative)."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_rank[at], NONE)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of many short pieces at once, with a row of trees for pieces of like lengths."""
        out: list[list[int]] = [[]] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in classes.items():
            if width > 64:
                for k in members:
                    out[k] = merge(self.first[np.frombuffer(pieces[k], np.uint8)].tolist(), self.ranks)
                continue
            flat = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in members]), np.uint8).reshape(-1, width)
            n, m = np.array([len(pieces[k]) for k in members]), len(members)
            ids = np.full((m, width + 1), -1)
            ids[:, :width] = np.where(np.arange(width) < n[:, None], self.first[flat], -1)
            tree = np.full((m, 2 * width), NONE)
            rank = self.rank_of(ids[:, :-1], ids[:, 1:])
            tree[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
            level = width // 2
            while level:
                tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
                level //= 2
            after = np.tile(np.append(np.arange(1, width + 1), width), (m, 1))
            before = np.tile(np.append(np.arange(-1, width - 1), 0), (m, 1))
            rows = np.flatnonzero(tree[:, 1] < NONE)
            while len(rows):
                root = tree[rows, 1]
                i, made = root % width, self.merged[root // width]
                j = after[rows, i]
                k = after[rows, j]
                ids[rows, i], ids[rows, j] = made, -1
                after[rows, i], before[rows, k] = k, i
                p = before[rows, i]
                rank = self.rank_of(made, ids[rows, k])
                tree[rows, width + i] = np.where(rank < NONE, rank * width + i, NONE)
                tree[rows, width + j] = NONE
                left = np.where(p >= 0, ids[rows, p], -1)
                rank = self.rank_of(left, made)
                p = np.where(p >= 0, p, i)
                tree[rows, width + p] = np.where(left >= 0, np.where(rank < NONE, rank * width + p, NONE), tree[rows, width + p])
                spots = [width + i, width + j, width + p]
                for _ in range(width.bit_length() - 1):
                    spots = [x >> 1 for x in spots]
                    for x in spots:
                        tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
                rows = rows[tree[rows, 1] < NONE]
            kept = ids >= 0
            ends = np.cumsum(kept.sum(1)).tolist()
            values, start = ids[kept].tolist(), 0
            for k, end in zip(members, ends):
                out[k] = values[start:end]
                start = end
        return out

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks, as little-endian 32-bit numbers, into the memo."""
        split = {c: [] if c in self.added else pieces(c) for c in chunks}
        distinct = list({p for ps in split.values() for p in ps})
        ids = dict(zip(distinct, (np.array(x, "<i4").tobytes() for x in self.merge_all([p.encode() for p in distinct]))))
        for c, ps in split.items():
            self.memo[c] = np.array([self.added[c]], "<i4").tobytes() if c in self.added else ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text that the word pattern treats alike apart and together: a space that one word follows
        begins a word, and a newline between words is a word; other white space is left to the pattern."""
        out = []
        for k, part in enumerate(self.split_added.split(text) if self.added else [text]):
            if k % 2:
                out.append(part)
            elif part[-1:] == " " or any([x in part for x in PAIRS]) or any([x in part for x in ODD]):
                out += pieces(part)
            elif part:
                out += CHUNKS.findall(part)
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        chunks = [self.chunks(text or "") for text in texts]
        if len(self.memo) > MEMO:
            self.before, self.memo = self.memo, {}
        fresh = set().union(*chunks).difference(self.memo)
        again = fresh.intersection(self.before)
        self.memo.update(zip(again, map(self.before.__getitem__, again)))
        fresh -= again
        if fresh:
            self.learn(fresh)
        of = self.memo.__getitem__
        out = [np.frombuffer(b"".join(map(of, c)), "<i4") for c in chunks]
        for c in fresh:
            if len(c) > LONG:
                del self.memo[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def codec(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded) for every row: the ids of its whole text, and the text that they decode to.

    path: the vocabulary file, at the same place on every machine. A null or empty text has no ids and decodes to
    the empty text. Rows are independent: repeated rows and null ids give a row each, other columns are not read,
    an empty table gives no rows. No shuffle; a worker holds one batch and a bounded memo.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            start, size, texts = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= FLUSH or k == batch.num_rows - 1:
                    ids = bpe.encode_all(texts)
                    offsets = np.cumsum([0, *map(len, ids)])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), lists, pa.array(map(bpe.decode, ids), pa.string())], names=[id_col, "token_ids", "decoded"])
                    start, size, texts = k + 1, 0, []

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what encode() returns."""
    return encoded.select(
        id_col,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
