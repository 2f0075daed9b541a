"""Candidate pairs from banded signatures, and their verification: shared by problems 2 and 4."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import shingles as S

#: ids up to this count (under 1 MB) are broadcast to filter a table; more go through a shuffled semi join
BROADCAST_IDS = 100_000


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0)


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(-1, width)


def featurize(texts: DataFrame, k: int) -> DataFrame:
    """(id, text, least, flag) -> (id, key, sig, flag) of the texts whose column `least` has at least 20 words.

    key: 128-bit hash of the shingle set; sig: packed signature; flag: a boolean that is carried along. Null, empty and
    short texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, sigs, flags = [], [], [], []
            for i, text, least, flag in zip(*(b.column(c).to_pylist() for c in range(4))):
                if len(S.words(least)) < 20:
                    continue
                s = S.shingle_set(S.words(text), k)
                ids.append(i)
                keys.append(S.set_key(s))
                sigs.append(S.signature(s))
                flags.append(flag)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), _list_column(sigs), pa.array(flags, pa.bool_())], ["id", "key", "sig", "flag"])

    return texts.mapInArrow(run, "id bigint, key binary, sig array<bigint>, flag boolean")


def only_ids(df: DataFrame, on: str, ids: DataFrame, how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose `on` is among ids.id (a materialised table of distinct ids), or with left_anti is not. Up to
    `most` ids are broadcast."""
    small = ids.limit(most + 1).count() <= most
    ids = ids.withColumnRenamed("id", "__id")
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), F.col(on) == F.col("__id"), how)


def alike(a: str, b: str, threshold: float) -> Column:
    """Whether the overlap of two array columns without repeats reaches the threshold: compared as integers, so that
    5 * shared >= 3 * union holds exactly where the ratio reaches 0.6."""
    shared = F.size(F.array_intersect(a, b))
    return shared * 10_000 >= (F.size(a) + F.size(b) - shared) * round(threshold * 10_000)


def verify(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, threshold: float, miss: float) -> DataFrame:
    """(a, b) -> the pairs (a, b) whose exact shingle overlap reaches the threshold.

    Stage 1 compares signatures batch by batch and drops a pair as soon as the posterior of reaching the
    threshold falls under `miss`; stage 2 computes the survivors' overlap from their whole texts.
    pairs: materialised; sigs: (id, sig); texts: (id, text).
    """
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    known = materialize(only_ids(sigs, "id", ids).select("id", F.slice("sig", 1, S.COMPARED).alias("sig")), "pair-sigs")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = S.survives(_matrix(b.column(2), S.COMPARED), _matrix(b.column(3), S.COMPARED), threshold, miss)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    joined = (pairs.join(known.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
              .join(known.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb"))
    left = materialize(joined.mapInArrow(prune, "a bigint, b bigint"), "pair-survivors")
    ids = materialize(left.select(F.col("a").alias("id")).union(left.select("b")).distinct(), "survivor-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _list_column([S.shingle_set(S.words(t), k) for t in b.column(1).to_pylist()])], ["id", "s"])

    full = materialize(only_ids(texts, "id", ids).mapInArrow(sets, "id bigint, s array<bigint>"), "survivor-sets")
    both = (left.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
    return both.where(alike("sa", "sb", threshold)).select("a", "b")
