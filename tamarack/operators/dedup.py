"""Exact and near-duplicate removal."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams
from ..functions import text as T
from ..storage import materialize, spread
from .tiles import Tiles, meet

TILE_LEAST, TILE_MOST = 2048, 65_536  # rows a tile: a fortieth of all, within these bounds


def exact(df: DataFrame, key: str, pos: str, source: str) -> DataFrame:
    """One row of each key: the best source, the earliest position on ties. A combined minimum picks it."""
    best = df.groupBy(key).agg(F.min(F.struct(T.source_rank(F.col(source)).alias("rank"), F.col(pos).alias("pos"))).alias("b"))
    return df.join(best.select(F.col("b.pos").alias(pos), F.col("b.rank").alias("source_rank")), pos)


def first_by_body(df: DataFrame, pos: str, body: str) -> DataFrame:
    """The first row of each normalised body."""
    return df.join(df.groupBy(T.body_key(F.col(body)).alias("k")).agg(F.min(pos).alias(pos)).select(pos), pos)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: Column, threshold: float = 0.85, cut: int | None = None) -> DataFrame:
    """(a, b), a < b: rows whose character shingles overlap by the threshold. Rows of equal shingle sets are a class: only
    its smallest id is paired with other classes, the rest are linked to it (see near_duplicate_classes)."""
    pairs, copies = near_duplicate_classes(df, id_col, text_col, F.lit(0), threshold, cut)
    return pairs.union(copies)


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: Column, rank: Column, threshold: float = 0.85, cut: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of equal shingle sets are a class, for which its first row by rank, then id, stands. Gives the pairs (a, b),
    a < b, of first rows whose character shingles overlap by the threshold, and (a, b) of each first row and the other
    rows of its class, which meet all that the first row meets. Candidates come from bit sketches of the sets (see
    functions/grams.py), compared each with each of like size in packed words, which loses no pair; they are checked
    exactly on the texts.

    Whole texts are compared; with cut=1000 their first 1,000 characters, as in the published operator.
    Texts under three characters have no shingles and meet nobody; null ids and texts take no part.
    """
    base = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), rank.cast("int").alias("rank"), text_col.alias("text")))
    marked = materialize(base.mapInArrow(partial(grams.sketch_rows, cut=cut), grams.SKETCHES), "shingle-sketches")
    classes = materialize(marked.groupBy("key").agg(F.min(F.struct("rank", "id", "n", "cell", "sketch")).alias("x")).select("key", "x.*"), "shingle-classes")
    # files and shuffles of ids are packed many times smaller than they are in memory: their size is no leave to broadcast
    copies = marked.select("key", F.col("id").alias("b")).join(classes.select("key", F.col("id").alias("a")).hint("merge"), "key").where("a != b").select("a", "b")
    pairs = materialize(_candidates(classes.select("id", "n", "cell", "sketch"), threshold), "shingle-candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = materialize(base.select("id", "text").join(ids.hint("merge"), "id", "left_semi"), "shingle-texts")
    both = pairs.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(partial(grams.alike_rows, threshold=threshold, cut=cut), "a bigint, b bigint"), copies


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of (id, n, cell, sketch): what the sketches do not rule out."""
    sizes = reps.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy("cell").toArrow()  # 64 cells for each doubling of n
    cells, rows, low, high = (sizes.column(c).to_numpy().astype("int64") for c in ("cell", "rows", "low", "high"))
    tiles = Tiles(rows, int(min(TILE_MOST, max(TILE_LEAST, rows.sum() // 40))))
    pairs = [(i, j) for j in range(len(tiles.low)) for i in range(j + 1) if high[tiles.high[i]] >= threshold * low[tiles.low[j]] - 1e-6]
    shared = reps.sparkSession.sparkContext.broadcast((cells, tiles))

    def place(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cells, tiles = shared.value
        return np.arange(len(b)), tiles.of(np.searchsorted(cells, b.column("cell").to_numpy()), b.column("id").to_numpy())

    return meet(reps, place, pairs, partial(grams.may_be_alike, threshold=threshold)).select("a", "b")


def greedy(df: DataFrame, id_col: str, text_col: Column, rank: Column, threshold: float = 0.85, cut: int | None = None) -> DataFrame:
    """(id) that stay when rows are taken by rank, then id, and a row leaves if a near-duplicate of it stayed.

    Rows of a class meet the same rows, so its first row decides: if it stays the others leave for it, and if it leaves
    for another row they come later and leave for that row too. Only first rows take part in the rounds.
    """
    pairs, copies = near_duplicate_classes(df, id_col, text_col, rank, threshold, cut)
    kept = greedy_keep(df.select(F.col(id_col).alias("id"), rank.alias("rank")), pairs)
    return kept.join(copies.select(F.col("b").alias("id")).hint("merge"), "id", "left_anti")


def greedy_keep(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id) that stay when rows are taken by rank, then id, and a row leaves if one that stayed is its near-duplicate:
    the pairs must hold all near-duplicates of the rows that they name (not links to a first row alone, see greedy).

    ids: (id, rank). Rounds: a row without an earlier undecided or kept neighbour stays, its later neighbours leave.
    """
    order = ids.select("id", F.struct("rank", "id").alias("o"))
    pairs = materialize(pairs, "greedy-pairs")  # read twice; packed ids are many times larger in memory, so none is broadcast
    edges = pairs.union(pairs.select("b", "a")).distinct()
    edges = (edges.hint("merge").join(order.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(order.select(F.col("id").alias("b"), F.col("o").alias("ob")).hint("merge"), "b").where("oa < ob").select("a", "b"))
    edges = materialize(edges, "greedy-edges")
    open_ = materialize(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "greedy-open")
    dropped = None
    while not open_.isEmpty():
        live = edges.join(open_.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").join(open_.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi")
        kept = open_.join(live.select(F.col("b").alias("id")).distinct().hint("merge"), "id", "left_anti")
        lost = materialize(live.join(kept.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "greedy-lost")
        dropped = lost if dropped is None else dropped.union(lost)
        open_ = materialize(open_.join(kept.hint("merge"), "id", "left_anti").join(lost.hint("merge"), "id", "left_anti"), "greedy-open")
    return ids.select("id") if dropped is None else ids.select("id").join(dropped.hint("merge"), "id", "left_anti")
