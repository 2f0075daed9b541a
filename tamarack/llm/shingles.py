"""Word shingles as 64-bit hashes, packed min-hash signatures and their Bayesian comparison."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
# a pair at 0.6 misses all bands with probability (1 - 0.6 ** 4) ** 80 = 1.5e-5; the first COMPARED are what pairs are judged by
BANDS, ROWS, COMPARED = 80, 4, 40
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_TAG = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_word_hash: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, lower-cased; null and empty give none."""
    return WORD.findall(text.lower()) if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def hash_words(ws: list[str]) -> np.ndarray:
    """One 64-bit hash a word, through a bounded memo."""
    memo = _word_hash
    if len(memo) > 400_000:
        memo.clear()
    out = []
    for w in ws:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(ws: list[str], k: int = 3) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; fewer than k words give the empty set."""
    if len(ws) < k:
        return np.empty(0, np.uint64)
    h = hash_words(ws)
    n = len(h) - k + 1
    acc = h[:n]
    with np.errstate(over="ignore"):
        for i in range(1, k):
            acc = _mix(acc * _M1 + _M3) + h[i : i + n]
        acc = _mix(acc * _M1)
    return np.unique(acc)


def set_key(s: np.ndarray) -> bytes:
    """128-bit key that equal sets share."""
    return xxhash.xxh3_128_digest(s.tobytes())


def signature(s: np.ndarray) -> np.ndarray:
    """BANDS words of 64 bits: band i packs ROWS min-hashes of 16 bits, xored with the band's tag.

    So the signature is also its list of band keys, 8 bytes each.
    """
    with np.errstate(over="ignore"):
        low = (s[:, None] * _MUL[None, :] + _ADD[None, :]).min(axis=0)
    lanes = (low & np.uint64(0xFFFF)).reshape(BANDS, ROWS)
    return ((lanes[:, 0] << np.uint64(48)) | (lanes[:, 1] << np.uint64(32)) | (lanes[:, 2] << np.uint64(16)) | lanes[:, 3]) ^ _TAG


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact overlap of two sorted distinct arrays; two empty sets give 0."""
    if not len(a) or not len(b):
        return 0.0
    i = len(np.intersect1d(a, b, assume_unique=True))
    return i / (len(a) + len(b) - i)


@lru_cache(maxsize=None)
def least_matches(threshold: float, miss: float, total: int, batch: int) -> tuple[int, ...]:
    """For n = batch, 2*batch, ...: the fewest matching lanes of n that keep a pair in the race.

    Uniform prior on the similarity; a pair leaves once P(similarity >= threshold | m of n match) < miss.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    log_s, log_d, above = np.log(grid), np.log1p(-grid), grid >= threshold
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            logp = m * log_s + (n - m) * log_d
            p = np.exp(logp - logp.max())
            if p[above].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = 1e-6, batch: int = 32) -> np.ndarray:
    """Sequential Bayesian pruning of signature pairs (two arrays of shape pairs x bands): a mask."""
    eq = (a.view(np.uint16).reshape(len(a), -1) == b.view(np.uint16).reshape(len(b), -1))
    total = eq.shape[1]
    alive = np.arange(len(a))
    seen = np.zeros(len(a), np.int32)
    for step, need in enumerate(least_matches(threshold, miss, total, batch)):
        seen[alive] += eq[alive, step * batch : (step + 1) * batch].sum(axis=1)
        alive = alive[seen[alive] >= need]
        if not len(alive):
            break
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep
