"""Problem 2: groups of records that recur with small edits.

Bodies: banded min-hash candidates, sequential Bayesian pruning of signature batches, exact check.
Subjects: sets of some nine words, where unlike texts of one pattern reach 0.5 and bands of min-hashes
cannot tell them from 0.6; there a band is one of a set's rarest words, chosen by the sizes of both
sets so that no pair at the threshold can miss all bands, and the check is exact at once (a set is
smaller than one batch of a signature). Sets of 39 words or more take the min-hash road as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..graph import connected_components
from ..storage import materialize, spread
from . import pairs as P
from . import prefix

SMALL_BUCKET = 9
LONG_SET = 64


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(id, band) -> distinct candidate pairs a < b: all pairs of small buckets; pivot pairs of larger ones.

    The pivot is the bucket's smallest id. Only buckets of at most SMALL_BUCKET rows are ordered in a
    window; a hot bucket takes part in combined minima and a skew-splittable join alone.
    """
    stats = rows.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    full = rows.join(stats, "band")
    star = full.where((F.col("n") > SMALL_BUCKET) & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    order = W.partitionBy("band").orderBy("id")
    near = (full.where(F.col("n") <= SMALL_BUCKET)
            .select(F.col("id").alias("b"), F.array(*[F.lag("id", i).over(order) for i in range(1, SMALL_BUCKET)]).alias("before"))
            .select("b", F.explode(F.array_compact("before")).alias("a")))
    return star.select("a", "b").union(near.select("a", "b")).distinct()


def left_over(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) of the texts of large buckets whose rows lie in different components after the pivots were linked.

    Usually empty, since a large bucket is one family. Rows without a component are one of their own.
    """
    comp = connected_components(edges)
    big = rows.join(comp.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
    mixed = big.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    return materialize(big.join(mixed, "band").select("id", "comp").distinct(), "mixed-buckets")


def minhash_edges(reps: DataFrame, texts: DataFrame, k: int, threshold: float, miss: float) -> DataFrame:
    """Verified pairs among distinct texts. reps: materialised (id, sig); texts: (id, text).

    What pivots leave open in large buckets is completed by the prefix filter, which compares only texts of different
    components: no bucket meets itself in full.
    """
    bands = reps.select("id", F.explode("sig").alias("band"))
    cand = materialize(bucket_pairs(bands), "candidates")
    edges = materialize(P.verify(cand, reps, texts, k, threshold, miss), "edges")
    large = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_BUCKET), "large-buckets")
    if not large.isEmpty():
        open_ = left_over(bands.join(large.select("band"), "band", "left_semi"), edges)
        if not open_.isEmpty():
            edges = edges.union(prefix.across(texts, open_, k, threshold))
    return edges


def body_edges(emails: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, k: int = 3, miss: float = 1e-6) -> DataFrame:
    """Edges (a, b) that join like texts of at least 20 words; equal shingle sets are linked to their first row."""
    texts = spread(emails.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(f"{id_col} is not null and length({text_col}) >= 39"))
    feats = materialize(P.featurize(texts.select("id", "text", "text", F.lit(None).cast("boolean")), k).drop("flag"), "features")
    classes = materialize(feats.groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "classes")
    copies = (feats.select("key", "id").join(classes.where("n > 1").select("key", F.col("id").alias("a")), "key")
              .where("id != a").select("a", F.col("id").alias("b")))
    return minhash_edges(classes.select("id", "sig"), texts, k, threshold, miss).union(copies)


def _rare_keys(threshold: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, small, large, own = [], [], [], [], []
            for i, ranked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(ranked)
                toks = [x["w"] for x in ranked]
                for m in range(max(least, math.ceil(threshold * n - 1e-9)), min(LONG_SET, math.floor(n / threshold + 1e-9)) + 1):
                    need = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
                    for w in toks[: n - need + 1]:
                        ids.append(i)
                        words.append(w)
                        small.append(min(n, m))
                        large.append(max(n, m))
                        own.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(small, pa.int32()), pa.array(large, pa.int32()), pa.array(own, pa.int32())], ["id", "w", "lo", "hi", "n"])

    return run


def subject_edges(log: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, least: int = 5) -> DataFrame:
    """Edges (a, b) that join texts of at least `least` different words whose word sets overlap by the threshold."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    sets = (log.where(f"{id_col} is not null and {text_col} is not null")
            .select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))).alias("s")).where(F.size("s") >= least)
            .withColumn("key", F.struct(F.xxhash64("s").alias("x"), F.hash("s").alias("y"), F.size("s").alias("n"))))
    classes = materialize(sets.groupBy("key").agg(F.min("id").alias("id"), F.first("s").alias("s"), F.count(F.lit(1)).alias("n")), "subject-classes")
    copies = (sets.select("key", "id").join(classes.where("n > 1").select("key", F.col("id").alias("a")), "key")
              .where("id != a").select("a", F.col("id").alias("b")))
    short = classes.where(F.size("s") <= LONG_SET)
    tokens = short.select("id", F.explode("s").alias("w"))
    freq = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = (tokens.join(freq, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ranked")))
    keys = ranked.mapInArrow(_rare_keys(threshold, least), "id bigint, w bigint, lo int, hi int, n int")
    banded = materialize(keys.select("id", F.struct("w", "lo", "hi").alias("band"), (F.col("n") == F.col("lo")).alias("small"), (F.col("n") == F.col("hi")).alias("large")), "subject-keys")
    cand = all_pairs(banded)
    lookup = classes.select("id", "s")
    both = cand.join(lookup.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(lookup.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    exact = both.where(P.alike("sa", "sb", threshold)).select("a", "b")
    edges = exact.union(copies)
    wordy = classes.where(F.size("s") >= math.ceil(threshold * LONG_SET))
    if wordy.isEmpty():
        return edges
    return edges.union(_long_edges(wordy, threshold))


def all_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b that share a band, one of them `small` and the other `large` in it.

    A rare-word band carries the two set sizes it serves: it pairs texts of one size with texts of the
    other that agree in one of their rarest words. Bands that cannot make a pair leave before the join.
    """
    useful = (rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("small").alias("s"), F.max("large").alias("l"))
              .where("n > 1 and s and l").select("band"))
    live = materialize(rows.join(useful, "band"), "live-bands")
    both = (live.where("small").select("band", F.col("id").alias("x")).join(live.where("large").select("band", F.col("id").alias("y")), "band").where("x != y"))
    return materialize(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "subject-candidates")


def _long_edges(wordy: DataFrame, threshold: float) -> DataFrame:
    """Word sets too long for rare-word bands: min-hash bands of the same sets."""
    from . import shingles as S

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [P.np.array(x, dtype=P.np.int64).view(P.np.uint64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), P._list_column([S.signature(s) for s in sets])], ["id", "sig"])

    sigs = materialize(wordy.select("id", "s").mapInArrow(sign, "id bigint, sig array<bigint>"), "long-sets")
    cand = all_pairs(sigs.select("id", F.explode("sig").alias("band"), F.lit(True).alias("small"), F.lit(True).alias("large")))
    look = wordy.select("id", "s")
    both = cand.join(look.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(look.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(P.alike("sa", "sb", threshold)).select("a", "b")


def groups(edges_by_field: dict[str, DataFrame]) -> DataFrame:
    """(field, row_id, group_id): the closed groups of two or more rows, one contraction for all fields."""
    tagged = None
    for i, (field, e) in enumerate(edges_by_field.items()):
        one = connected_components(materialize(e, "edges")).select(F.lit(field).alias("field"), F.col("node").alias("row_id"), F.col("component").alias("group_id"))
        tagged = one if tagged is None else tagged.union(one)
    return tagged


def p2_found(spark, sf_dir: str) -> DataFrame:
    emails = spark.read.parquet(f"{sf_dir}/emails.parquet")
    log = spark.read.parquet(f"{sf_dir}/triage_log.parquet")
    return groups({"body_text": body_edges(emails, "rec_id", "body_text"), "subject": subject_edges(log, "id", "subject")})
