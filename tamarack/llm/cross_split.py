"""Problem 4: mails of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, spread
from . import pairs as P


def overlaps(emails: DataFrame, threshold: float = 0.6, k: int = 3, miss: float = 1e-6) -> DataFrame:
    """(rec_id_a, rec_id_b): pairs of a train and a val/test row whose shingle overlap reaches the threshold.

    Equal shingle sets form a class with one row per side; band keys are joined train to evaluation only, so
    pairs inside a split never arise. The members are joined back at the end: every pair is returned.
    Null or other splits, null texts and bodies under 20 words take no part. Extra columns are ignored.
    """
    rows = emails.where("split in ('train', 'val', 'test') and rec_id is not null and length(body_text) >= 39")
    joined = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.col("body_text"))
    texts = spread(rows.select(F.col("rec_id").alias("id"), joined.alias("text"), F.col("body_text").alias("least"), (F.col("split") == "train").alias("train")))
    feats = materialize(P.featurize(texts, k).withColumnRenamed("flag", "train"), "split-features")
    # equal sets have equal signatures, so a class takes any of them
    classes = materialize(
        feats.groupBy("key").agg(F.min("id").alias("rep"), F.max("train").alias("t"), F.min("train").alias("all_t"), F.first("sig").alias("sig"))
        .select("key", "rep", "t", (~F.col("all_t")).alias("e"), "sig"), "split-classes")
    members = feats.select("key", "id", "train").join(classes.select("key", "rep").hint("merge"), "key").select("rep", "id", "train")
    sigs = classes.select(F.col("rep").alias("id"), "sig", "t", "e")
    bands = sigs.select("id", "t", "e", F.explode("sig").alias("band"))
    cand = (bands.where("t").select("band", F.col("id").alias("a")).join(bands.where("e").select("band", F.col("id").alias("b")), "band")
            .where("a != b").select("a", "b").distinct())
    cand = materialize(cand, "split-candidates")
    near = P.verify(cand, sigs.select("id", "sig"), texts.select("id", "text"), k, threshold, miss)
    same = classes.where("t and e").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    links = materialize(near.union(same), "split-links")
    train = members.where("train").select(F.col("rep").alias("a"), F.col("id").alias("x"))
    evals = members.where("not train").select(F.col("rep").alias("b"), F.col("id").alias("y"))
    out = links.join(train.hint("merge"), "a").join(evals.hint("merge"), "b")
    return out.select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b")).distinct()


def report(pairs: DataFrame, emails: DataFrame) -> DataFrame:
    """(split, source, pairs, evaluation_rows, train_rows): confirmed overlaps per evaluation split and source."""
    side = emails.select("rec_id", "split", "source")
    long = pairs.withColumn("p", F.struct("rec_id_a", "rec_id_b"))
    ends = (long.select("p", F.col("rec_id_a").alias("rec_id"), F.col("rec_id_b").alias("other"))
            .union(long.select("p", F.col("rec_id_b"), F.col("rec_id_a"))))
    evals = ends.join(side, "rec_id").where("split in ('val', 'test')")
    return evals.groupBy("split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("rec_id").alias("evaluation_rows"), F.countDistinct("other").alias("train_rows"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/emails.parquet"))


def p4_report(spark, sf_dir: str) -> DataFrame:
    emails = spark.read.parquet(f"{sf_dir}/emails.parquet")
    return report(overlaps(emails), emails)
