"""Prefix filter on word shingles: candidate pairs of like sets, none at the threshold lost.

Of two sets that overlap by t the shorter one shares at least 2t/(1+t) of its shingles and the longer one t, so in
any common order of all shingles their first few hold any wanted number of common ones. Frequent shingles come last
in that order, as far as a bounded sample of the rows shows them; the sample bears on cost, never on the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import pairs as P
from . import shingles as S

MEET = 4  # shingles that a pair must share among the first of both; each costs one more key a row
SAMPLE = 8  # one row in so many shows which shingles are frequent
HOT_SEEN = 2  # rows of the sample that make a shingle frequent
HOT_MOST = 500_000  # frequent shingles sent to every task (8 MB), the most frequent first


def sets(rows: DataFrame, k: int) -> DataFrame:
    """(id, text) -> (id, s): the shingle sets of texts of at least 20 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(i, S.shingle_set(ws, k)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(ws := S.words(t)) >= 20]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), P._list_column([s for _, s in kept])], ["id", "s"])

    return rows.mapInArrow(run, "id bigint, s array<bigint>")


def hot_shingles(texts: DataFrame, k: int) -> list[np.ndarray]:
    """Hashes, ascending, and counts of the shingles that many rows of a sample hold."""
    some = sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), k)
    counts = some.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_SEEN)
    found = counts.orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return [h[order], n[order]]


def ordered(s: np.ndarray, hot: list[np.ndarray], threshold: float) -> tuple[np.ndarray, int]:
    """A set in the common order (by count in the sample, then hash), and how many come first: as many as a like set
    must share MEET of."""
    known, counts = hot
    if len(known) and len(s):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rank = np.where(known[at] == s, counts[at], 0)
        if rank.any():
            s = s[np.lexsort((s, rank))]
    return s, min(len(s), len(s) - math.ceil(threshold * len(s) - 1e-9) + MEET)


def keys(texts: DataFrame, hot: list[np.ndarray], k: int, threshold: float) -> DataFrame:
    """(id, text) -> (id, n, at, h): the first shingles h of each text of at least 20 words, at their places in the
    common order; n: how many shingles it has."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, firsts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(ws := S.words(t)) >= 20 and len(s := S.shingle_set(ws, k)):
                    ids.append(i)
                    sizes.append(len(s))
                    s, first = ordered(s, shared.value, threshold)
                    firsts.append(s[:first])
            lengths = [len(f) for f in firsts]
            h = np.concatenate(firsts) if firsts else np.empty(0, np.uint64)
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]) if lengths else np.empty(0, np.int32)
            cols = [np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), at, h.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "n", "at", "h"])

    return texts.mapInArrow(run, "id bigint, n int, at int, h bigint")


def packed(t: DataFrame, x: str) -> DataFrame:
    """(h, id, n, at) -> (h, x, px): a side of a meeting in rows as narrow as they get: 40 bits of the hash, which may
    make a meeting too many, never one too few, and size and place in one number."""
    return t.select(F.shiftrightunsigned("h", 24).alias("h"), F.col("id").alias(x), F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("at").cast("bigint")).alias(f"p{x}"))


def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key tables as the first (a) and second (b) of a pair."""
    return packed(left, "a"), packed(right, "b")


def met(joined: DataFrame, threshold: float) -> DataFrame:
    """Key tables (a, pa) and (b, pb) joined on h -> (a, b) that meet often enough.

    Sizes n and m that overlap by the threshold t share c >= t / (1 + t) * (n + m) shingles. The MEET first of the
    shared ones (all, if c is less) have at least c - MEET shared ones after them in both texts, which bounds their
    places; only meetings at such places count, and a pair with fewer of them is none.
    """
    size, place = (lambda p: F.shiftright(p, 32)), (lambda p: F.col(p).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    na, nb = size("pa"), size("pb")
    need: Column = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - F.lit(1e-6))
    after = need - F.least(need, F.lit(MEET))
    near = joined.where((place("pa") + after < na) & (place("pb") + after < nb))
    often = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min(need).alias("need"))
    return often.where(F.col("met") >= F.least(F.col("need"), F.lit(MEET))).select("a", "b")


def exact(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b) -> those whose shingle overlap reaches the threshold. pairs: materialised; texts: (id, text)."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "prefix-ids")
    full = materialize(sets(P.only_ids(texts, "id", ids), k), "prefix-sets")
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(P.alike("sa", "sb", threshold)).select("a", "b")


def across(texts: DataFrame, labels: DataFrame, k: int, threshold: float) -> DataFrame:
    """Like pairs (a, b), a < b, of texts of different labels. texts: (id, text); labels: (id, comp), materialised.

    Of each key, rows outside its largest label meet the rows of other labels: a label that holds most rows of a key
    never meets itself.
    """
    some = P.only_ids(texts, "id", labels.select("id"))
    found = materialize(keys(some, hot_shingles(some, k), k, threshold).join(labels, "id"), "prefix-keys")
    size = found.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = size.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("h", "top")
    small = found.join(top, "h").where("comp != top")
    label = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    joined = packed(small, "a").join(label("a"), "a").join(packed(found, "b").join(label("b"), "b"), "h").where("ca != cb")
    # a pair of two small rows meets from both sides: taken once
    swap = F.col("a") > F.col("b")
    once = joined.select("h", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("pa"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("pb")).distinct()
    return exact(materialize(met(once, threshold), "prefix-candidates"), some, k, threshold)
