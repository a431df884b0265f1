"""URL filters: glob rules packed into multiword Shift-And masks and run side by side over canonical URLs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Between host and path of a canonical URL; neither can hold it.
MARK = b"#"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """verdict allow or block for host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production filter.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """Anchored glob patterns as one bit-parallel automaton.

    ``*`` stands for any run of bytes but MARK, ``**`` for any run of bytes. A pattern of m literals takes m + 1
    bits; bit j is set after its first j literals. Bytes that a star takes keep a bit where it is, literals move
    it up; words pass their top bit on to the next.
    """

    def __init__(self, patterns: list[bytes]):
        bits, self.final, starts = 0, [], []
        moves: list[tuple[int, int]] = []
        stays: list[tuple[int, bool]] = []
        for pattern in patterns:
            starts.append(bits)
            i = 0
            while i < len(pattern):
                if pattern[i : i + 1] == b"*":
                    whole = pattern[i : i + 2] == b"**"
                    stays.append((bits, whole))
                    i += 1 + whole
                else:
                    bits += 1
                    moves.append((pattern[i], bits))
                    i += 1
            self.final.append(bits)
            bits += 1
        self.words = bits // 64 + 1
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for byte, bit in moves:
            self.move[byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, whole in stays:
            takes = [b for b in range(256) if whole or b != MARK[0]]
            self.stay[takes, bit // 64] |= np.uint64(1 << bit % 64)
        self.start = np.zeros(self.words, np.uint64)
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each pattern: whether the pattern fits the whole URL."""
        length = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        first = np.cumsum(length) - length
        state = np.tile(self.start, (len(urls), 1))
        live = np.searchsorted(-length[order], -np.arange(1, max(length, default=0) + 1), side="right")
        for at, n in enumerate(live):
            rows = order[:n]
            now, byte = state[rows], flat[first[rows] + at]
            up = now << np.uint64(1)
            up[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[rows] = up & self.move[byte] | now & self.stay[byte]
        final = np.array(self.final, np.int64)
        return (state[:, final // 64] >> (final % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; rule: the text of the longest rule that fits, else null.

    Of rules of one length the first in ``rules`` wins; a URL that none fits gets ``default``. A null url, one
    without ``://``, or an empty one has an empty host and path. Repeated rows and null ids give a row each, other
    columns are not read, an empty table gives no rows. No shuffle; long URLs take a step for each byte.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    patterns = [p for r in ranked for p in (f"{r.host}#{r.path}**".encode(), f"*.{r.host}#{r.path}**".encode())]
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    texts, verdicts = [*(r.text for r in ranked), None], [*(r.verdict for r in ranked), default]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(patterns)
        for batch in batches:
            if not batch.num_rows:
                continue
            urls = [h.encode() + MARK + p.encode() for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            fits = automaton.match(urls).reshape(len(urls), len(ranked), 2).any(2)
            best = np.where(fits.any(1), fits.argmax(1), len(ranked)).tolist() if ranked else [0] * len(urls)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([texts[k] for k in best], pa.string()), pa.array([verdicts[k] for k in best], pa.string())], names=schema.names)

    url = F.col(url_col).cast("string")
    return pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path")).mapInArrow(run, schema)
