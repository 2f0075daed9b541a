"""Rows that are compared each with each in tasks of bounded size.

Rows lie in cells (sizes, slices of a hash). Neighbouring cells join to a tile while they hold at most a given number of
rows; a cell that holds more is cut into several tiles. A task compares one tile with itself or with another, in packed
numbers within an Arrow batch: no row is made of a pair before it is one, and what is shuffled is each row once for
every task of its tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FOUND = "a bigint, b bigint, distance bigint"
_found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int64())])


class Tiles:
    """counts: rows by cell; most: rows a tile; starts: cells that begin a tile."""

    def __init__(self, counts: np.ndarray, most: int, starts: Iterable[int] = ()):
        self.first, self.parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        self.low: list[int] = []  # first and last cell of each tile
        self.high: list[int] = []
        begin, room = set(starts), 0
        for c, n in enumerate(counts.tolist()):
            cut = -(-n // most)
            if cut > 1 or not self.low or n > room or c in begin:
                self.first[c], self.parts[c], room = len(self.low), max(1, cut), most if cut <= 1 else 0
                self.low += [c] * max(1, cut)
                self.high += [c] * max(1, cut)
            self.first[c] = self.first[c] if cut > 1 else len(self.low) - 1
            self.high[-1] = c
            room -= n

    def of(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The tile of each row."""
        mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cells] + (mixed % self.parts[cells].astype(np.uint64)).astype(np.int64)


def meet(rows: DataFrame, place: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], pairs: list[tuple[int, int]], compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """FOUND of all tasks. place: the rows of a batch and the tile each goes to; pairs: the tiles (i, j), i <= j, of each
    task; compare: rows of a task with their side (0 of i, 1 of j; all 0 where i is j) -> a, b, distance."""
    tiles = 1 + max((j for _, j in pairs), default=0)
    goes: list[list[int]] = [[] for _ in range(tiles)]
    for task, (i, j) in enumerate(pairs):
        goes[i].append(2 * task)
        if i != j:
            goes[j].append(2 * task + 1)
    sizes = np.array([len(g) for g in goes], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((sizes, np.concatenate([[0], np.cumsum(sizes)])[:-1], np.array([x for g in goes for x in g], np.int64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, begin, to = shared.value
        for b in batches:
            at, tile = place(b)
            n = sizes[tile]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            task = to[np.repeat(begin[tile], n) + step]
            out = b.take(pa.array(np.repeat(at, n)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(task // 2), pa.array((task % 2).astype(np.int32))], [*out.schema.names, "task", "side"])

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in compare(table)], schema=_found)

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    parts = max(1, min(len(pairs), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.mapInArrow(send, f"{kinds}, task bigint, side int").repartition(parts, "task").groupBy("task").applyInArrow(run, FOUND)
