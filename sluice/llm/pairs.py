"""Links within groups of rows, for operators that find near pairs by shared keys.

A row has a key and a kind. LEFT rows of a key are compared with each other, with its RIGHT and its PROBE rows; no
other two are compared. Groups beyond ``block`` rows are dealt into blocks, and each pair of blocks into a tile of
its own, so no task holds a whole group: tile (i, i) has block i as LEFT rows and all the group's PROBE rows, tile
(i, j) has block i as LEFT and block j as RIGHT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEFT, RIGHT, PROBE = 0, 1, 2
#: A tile is a number under this within its key.
TILES = 1 << 24
#: PROBE rows of one tile that are compared at a time.
BATCH = 50_000


def deal(keys: np.ndarray, probe: np.ndarray, spot: np.ndarray, blocks: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tile key, kind) for every copy of the rows that the tiles need, and how many blocks its key has.

    keys: each row's key, under 2^39; probe: whether it is a PROBE; spot: a number that says which block it is in;
    blocks: how many blocks each hot key has (at most 4096; other keys have one).
    """
    row = np.arange(len(keys))
    hot_keys = np.array(sorted(blocks), np.int64)
    if not len(hot_keys):
        return row, keys * TILES, np.where(probe, PROBE, LEFT), np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
    hot = hot_keys[at] == keys
    n = np.where(hot, np.array([blocks[k] for k in hot_keys.tolist()])[at], 1)
    copies = np.repeat(row, n)
    other = np.arange(len(copies)) - np.repeat(np.cumsum(n) - n, n)
    own = (spot % n.astype(np.uint64)).astype(np.int64)[copies]
    is_probe = probe[copies]
    low, high = np.where(is_probe, other, np.minimum(own, other)), np.where(is_probe, other, np.maximum(own, other))
    kind = np.where(is_probe, PROBE, np.where(own <= other, LEFT, RIGHT))
    return copies, keys[copies] * TILES + low * 4096 + high, kind, n[copies]


def hot_keys(counts: DataFrame, block: int) -> dict[int, int]:
    """How many blocks the keys with over ``block`` rows have, from (key, n). At most rows / block keys are hot; the
    callers choose block so that this is bounded."""
    return {r.key: min(4096, -(-r.n // block)) for r in counts.where(f"n > {block}").collect()}


def compare(rows: DataFrame, links: Callable[[pa.Table, np.ndarray, np.ndarray, bool], Iterator[pa.RecordBatch]], schema: str, tasks: int) -> DataFrame:
    """Runs links(table, starts, kinds, again) over rows (tile, kind, ...) sorted by tile and kind.

    table holds whole tiles, each from starts[k] to starts[k + 1]; but PROBE rows of one tile may come in several
    tables, each time behind the tile's other rows; again says that the first tile's others were seen before.
    A worker holds one tile's blocks and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        again = False

        def ready(table: pa.Table) -> Iterator[pa.RecordBatch]:
            tile, kind = table.column("tile").to_numpy(), table.column("kind").to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
            yield from links(table.combine_chunks(), starts, kind, again)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            tile = table.column("tile").to_numpy()
            last = int(np.searchsorted(tile, tile[-1]))
            if last:
                yield from ready(table.slice(0, last))
                again = False
            held = table.slice(last)
            probes = held.num_rows - int(np.searchsorted(held.column("kind").to_numpy(), PROBE))
            if probes > BATCH:
                yield from ready(held)
                held, again = held.slice(0, held.num_rows - probes), True
        if held is not None and held.num_rows:
            yield from ready(held)

    return rows.repartition(tasks, "tile").sortWithinPartitions("tile", "kind").mapInArrow(run, schema)
