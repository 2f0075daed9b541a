"""Samples, caps and splits, all in hash order where the original order was random."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .audit import null_safe

SEED = 42


def shuffled(*cols: str) -> list[Column]:
    """A fixed order that looks random: by md5 of the columns and the seed."""
    return [F.md5(F.concat_ws("|", F.lit(str(SEED)), *[F.col(c).cast("string") for c in cols])), *map(F.col, cols)]


def random_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows in the fixed random order: a top-n, no full sort."""
    return df.orderBy(*shuffled(id_col)).limit(n)


def capped(df: DataFrame, key: str, pos: str, cap: int) -> DataFrame:
    """The first `cap` rows of each key by position; Spark keeps only that many a task before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(pos))).where(f"rn <= {int(cap)}").drop("rn")


def split_by_order(df: DataFrame, part: list[str], bucket: Column, order: list[Column], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """The rows with `split`: the first floor(n * train) of a part train, the next floor(n * val) val, the rest test.

    `bucket` never falls along the order and cuts a part into many ranges: a row's number is the count of the ranges
    before its own and its number inside, so no task sorts a whole part.
    """
    rows = df.withColumn("__b", bucket)
    size = rows.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__m"))
    all_ = W.partitionBy(*part)
    size = size.withColumns({"__n": F.sum("__m").over(all_), "__before": F.coalesce(F.sum("__m").over(all_.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).drop("__m")
    rows = null_safe(rows, size, [*part, "__b"])
    rn = F.col("__before") + F.row_number().over(W.partitionBy(*part, "__b").orderBy(*order))
    n_train, n_val = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return rows.withColumn("split", F.when(rn <= n_train, "train").when(rn <= n_train + n_val, "val").otherwise("test")).drop("__b", "__n", "__before")


ERA_ORDER = {"legacy": 0, "mid": 1, "recent": 2}


def temporal_split(df: DataFrame) -> DataFrame:
    """Per label and augmentation: organic rows by era, then id; augmented ones in the fixed random order."""
    era = F.coalesce(*[F.when(F.col("era_bucket") == e, k) for e, k in ERA_ORDER.items()], F.lit(1))
    first = F.when(F.col("augmented"), F.lit(0)).otherwise(era)
    second = F.when(F.col("augmented"), shuffled("rec_id")[0]).otherwise(F.lit(""))
    lo, hi = df.agg(F.min("rec_id"), F.max("rec_id")).first()
    step = max(1, ((hi or 0) - (lo or 0)) // 1024 + 1)
    bucket = F.when(F.col("augmented"), F.conv(F.substring(second, 1, 3), 16, 10).cast("bigint")).otherwise(first * 1025 + F.floor((F.col("rec_id") - F.lit(lo or 0)) / step))
    return split_by_order(df, ["label", "augmented"], bucket, [first, second, F.col("rec_id")])


def stratified_split(df: DataFrame, least: int = 3) -> DataFrame:
    """Strata of label and source under `least` organic rows leave; augmented rows go to train."""
    organic = df.where("not augmented")
    big = organic.groupBy("label", "source").count().where(f"count >= {least}").select("label", "source")
    bucket = F.conv(F.substring(shuffled("rec_id")[0], 1, 3), 16, 10).cast("int")
    parts = split_by_order(organic.join(big, ["label", "source"]), ["label", "source"], bucket, shuffled("rec_id"))
    return parts.unionByName(df.where("augmented").withColumn("split", F.lit("train")))


def budgeted(df: DataFrame, target_min: int, target_max: int, era_caps: dict[str, float], source_share: float = 0.4, synthetic_cap: float = 0.25) -> DataFrame:
    """A sample under era, source and augmentation budgets, organic rows first, each label for itself.

    The budgets are read online, so the order decides. What can be decided by place alone is: per era and
    source no more rows than the budget can matter, so the walk sees at most budget x groups rows a label,
    whatever the table's size; the walk itself is one task a label.
    """
    target = (target_min + target_max) // 2
    limit = {**{e: int(target * c) for e, c in era_caps.items()}, "unknown": int(target * 0.6)}
    per_source = int(target * source_share)
    group = ["label", "augmented", "era_bucket", "source"]
    rn = F.row_number().over(W.partitionBy(*group).orderBy(*shuffled("rec_id")))
    slim = df.select("rec_id", *group).withColumn("rn", rn).where(F.col("rn") <= min(target_max, per_source))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["augmented", "era_bucket", "source", "rn"])
        eras: dict = {}
        sources: dict = {}
        picked, made = [], 0
        for rec, aug, era, src in zip(pdf["rec_id"], pdf["augmented"], pdf["era_bucket"], pdf["source"]):
            if len(picked) >= target_max:
                break
            full = eras.get(era, 0) >= limit.get(era, target) or sources.get(src, 0) >= per_source
            if full or (aug and (made + 1) / (len(picked) + 1) > synthetic_cap):
                continue
            picked.append(rec)
            eras[era] = eras.get(era, 0) + 1
            sources[src] = sources.get(src, 0) + 1
            made += bool(aug)
        return pd.DataFrame({"rec_id": picked}, dtype="int64")

    return df.join(slim.groupBy("label").applyInPandas(walk, "rec_id bigint"), "rec_id")
