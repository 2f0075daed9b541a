"""Character shingles in Arrow batches, and bit sketches of them that show which sets may be alike.

Sets of n and m that overlap by t differ in at most (1 - t) / (1 + t) * (n + m) shingles. A sketch holds for each bit
whether an odd number of the set's shingles fall on it, so two sketches differ in no more bits than their sets in
shingles: pairs whose sketches differ in more are none, and no pair at the threshold is lost. A sketch has between half
a bit and one bit a shingle; halves laid on each other give the sketch of half the length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MOST_BITS = 1 << 15
SKETCHES = "id bigint, rank int, key binary, n int, cell int, sketch binary"
_SPACE = re.compile(r"\s+")


def shingles(text: str | None, memo: dict | None = None, cut: int | None = None) -> np.ndarray:
    """Sorted distinct numbers, one for each three characters of the collapsed, lower-cased text, or of its first `cut`
    characters: their three code points. `memo` is not needed."""
    t = _SPACE.sub(" ", (text or "").lower())[:cut]
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]) if len(c) > 2 else np.empty(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's shingles over as many bits, a power of two, as it has shingles at least (64 to MOST_BITS)."""
    bits = min(MOST_BITS, max(64, 1 << (len(s).bit_length() - 1)))
    h = s * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    at = ((h >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def cell(n: int) -> int:
    """A number that rises with n, from its seven leading bits."""
    shift = max(0, n.bit_length() - 7)
    return shift * 128 + (n >> shift)


def sketch_rows(batches: Iterator[pa.RecordBatch], cut: int | None = None) -> Iterator[pa.RecordBatch]:
    """(id, rank, text) -> SKETCHES; texts without shingles give no row. key: 128-bit hash of the set."""
    for b in batches:
        rows = [(i, k, xxhash.xxh3_128_digest(s.tobytes()), len(s), cell(len(s)), sketch(s)) for i, k, t in zip(*(c.to_pylist() for c in b.columns)) if len(s := shingles(t, None, cut))]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "rank", "key", "n", "cell", "sketch"])


class Side:
    """Rows (id, n, sketch) of a task, by n, in runs of equally long sketches."""

    def __init__(self, table: pa.Table):
        n = table.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        ids, n, held = table.column("id").to_numpy()[order], n[order], table.column("sketch").take(pa.array(order)).to_pylist()
        ends = np.flatnonzero(np.diff([len(x) for x in held])) + 1
        self.runs = []
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(held)]):
            if hi > lo:
                self.runs.append((ids[lo:hi], n[lo:hi].astype(np.int64), np.ascontiguousarray(np.frombuffer(b"".join(held[lo:hi]), "<u8").reshape(hi - lo, -1).T)))


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """(words, rows) laid in halves until `to` words are left."""
    while len(words) > to:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_be_alike(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bits that differ), a < b, of a task's rows (see operators/tiles.py) whose sketches do not rule them out."""
    side = table.column("side").to_numpy()
    left = Side(table.filter(pa.array(side == 0)))
    right, share = Side(table.filter(pa.array(side == 1))) if side.any() else left, (1 - threshold) / (1 + threshold)
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
    for p, (ida, na, wa) in enumerate(left.runs):
        for q, (idb, nb, wb) in enumerate(right.runs):
            if right is left and q < p:
                continue
            words = min(len(wa), len(wb))
            x, y, some = folded(wa, words), folded(wb, words), max(1, math.ceil(words * 5 / 8))
            for i in range(0, len(ida), 128):
                i1 = min(i + 128, len(ida))
                j, end = np.searchsorted(nb, [threshold * na[i] - 1e-6, na[i1 - 1] / threshold + 1e-6])
                for j0 in range(max(int(j), i) if right is left and p == q else int(j), int(end), 2048):
                    j1 = min(j0 + 2048, int(end))
                    d = np.zeros((i1 - i, j1 - j0), np.uint16)
                    for w in range(some):
                        d += np.bitwise_count(x[w, i:i1, None] ^ y[w, None, j0:j1])
                    u, v = np.nonzero(d <= min(2**16 - 1, int(share * int(na[i1 - 1] + nb[j1 - 1]) + 1e-6)))
                    at, bt = i + u, j0 + v
                    n, m, most = na[at], nb[bt], d[u, v].astype(np.int64)
                    if some < words:
                        most += np.bitwise_count(x[some:, at] ^ y[some:, bt]).sum(axis=0, dtype=np.int64)
                    ok = (most <= share * (n + m) + 1e-6) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6) & (ida[at] != idb[bt])
                    if right is left and p == q:
                        ok &= at < bt
                    a, b = ida[at[ok]], idb[bt[ok]]
                    out.append((np.minimum(a, b), np.maximum(a, b), most[ok]))
    a, b, d = (np.concatenate(c) for c in zip(*out))
    return a, b, d


def alike_rows(batches: Iterator[pa.RecordBatch], threshold: float, cut: int | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) -> (a, b) whose shingles overlap by the threshold."""
    last: tuple = (None, None)
    for r in batches:
        keep = []
        for x, y in zip(r.column(2).to_pylist(), r.column(3).to_pylist()):
            if last[0] != x:
                last = (x, shingles(x, None, cut))
            s, t = last[1], shingles(y, None, cut)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(both >= threshold * (len(s) + len(t) - both))
        yield r.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
