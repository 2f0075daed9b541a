"""Measures of scored rows: y (0 or 1), p (probability of 1). Each is one or two combined aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EDGES = [k / 10 for k in range(11)]
EDGES[3] = 0.30000000000000004


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1; 0 where a denominator is empty."""
    hit = F.col("p") >= threshold
    a = df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in {"tp": hit & (F.col("y") == 1), "fp": hit & (F.col("y") == 0), "tn": ~hit & (F.col("y") == 0), "fn": ~hit & (F.col("y") == 1)}.items()])
    div = lambda x, y: F.when(y == 0, F.lit(0.0)).otherwise(x / y)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return a.select("tp", "fp", "tn", "fn", div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def by_score(df: DataFrame) -> DataFrame:
    """(p, pos, neg): rows of equal score first become one, so what follows sorts scores, not rows."""
    return df.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def auc(df: DataFrame) -> DataFrame:
    """roc_auc (ties count half) and average precision, exactly.

    Scores are cut into 1024 ranges; totals of the ranges give each its start, so the running sums are taken
    inside ranges and no task holds all scores.
    """
    s = by_score(df).withColumn("r", F.least(F.floor(F.col("p") * 1024), F.lit(1023)).cast("int"))
    totals = s.groupBy("r").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    up = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # at most 1024 rows
    down = W.orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("r", F.coalesce(F.sum("tn").over(up), F.lit(0)).alias("neg_below"), F.coalesce(F.sum("tp").over(down), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("tn").over(down), F.lit(0)).alias("neg_above"))
    inside_up = W.partitionBy("r").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    inside_down = W.partitionBy("r").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    x = s.join(F.broadcast(base), "r").select(
        "pos", "neg", (F.col("neg_below") + F.coalesce(F.sum("neg").over(inside_up), F.lit(0))).alias("below"),
        (F.col("pos_above") + F.sum("pos").over(inside_down)).alias("tp"), (F.col("neg_above") + F.sum("neg").over(inside_down)).alias("fp"))
    a = x.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select(F.when(F.col("P") * F.col("N") > 0, F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"), F.when(F.col("P") > 0, F.col("ap") / F.col("P")).alias("average_precision"))


def brier_logloss(df: DataFrame) -> DataFrame:
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    return df.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("log_loss"))


def _bin(p: Column, edges: list[float] = EDGES) -> Column:
    """Number of the half-open bin by the edges themselves; null from the last edge on."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((p >= edges[k]) & (p < edges[k + 1]), k).otherwise(out)
    return out


def ece_decision(df: DataFrame) -> DataFrame:
    """The gap of decision accuracy and mean probability by bin of the probability: the published formula,
    which charges confident negatives and drops p = 1."""
    n = df.count()
    b = df.withColumn("bin", _bin(F.col("p"))).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("int")).alias("acc"), F.avg("p").alias("conf"))
    return b.agg(F.coalesce(F.sum(F.col("n") / F.lit(max(n, 1)) * F.abs(F.col("acc") - F.col("conf"))), F.lit(0.0)).alias("ece"))


def ece_toplabel(df: DataFrame) -> DataFrame:
    """The same with the confidence of the decision, max(p, 1 - p), which is what calibration means."""
    c = F.greatest(F.col("p"), 1 - F.col("p"))
    b = (df.select(c.alias("c"), (F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("int").alias("ok")).groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).alias("bin"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("acc"), F.avg("c").alias("conf")))
    t = b.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("g"))
    return t.select(F.when(F.col("t") > 0, F.col("g") / F.col("t")).otherwise(0.0).alias("ece"))


def calibration_curve(df: DataFrame) -> DataFrame:
    """(bin, n, mean_p, rate) of ten bins; p = 1 falls into the last."""
    return df.groupBy(F.coalesce(_bin(F.col("p")), F.lit(9)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def threshold_sweep(df: DataFrame, steps: int = 20) -> DataFrame:
    """(threshold, tp, fp, tn, fn) for 1/steps ... (steps-1)/steps.

    Rows become a histogram of the thresholds they reach; its suffix sums are the counts, so no row is
    repeated for each threshold.
    """
    cuts = [k / steps for k in range(1, steps)]
    reach = F.lit(0)
    for c in cuts:
        reach = reach + (F.col("p") >= c).cast("int")
    h = df.groupBy(reach.alias("k")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    stats = [F.coalesce(F.sum(F.when(F.col("k") >= i + 1, F.col(c))), F.lit(0)) for i in range(len(cuts)) for c in ("pos", "neg")]
    both = h.agg(F.array(*stats).alias("s"), F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("threshold"), F.col("s")[2 * i].alias("tp"), F.col("s")[2 * i + 1].alias("fp")) for i, c in enumerate(cuts)])).alias("x"), "P", "N")
    return rows.select("x.threshold", "x.tp", "x.fp", (F.col("N") - F.col("x.fp")).alias("tn"), (F.col("P") - F.col("x.tp")).alias("fn"))


def score_bands(df: DataFrame, cuts: tuple[float, ...] = (90.0, 75.0, 55.0)) -> DataFrame:
    """(band, n, positives, missed) by a score's ranges, each open at its lower cut; band 0 is the highest.

    df: score, y, hit (0 or 1)."""
    band = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        band = F.when(F.col("score") > cuts[k], k).otherwise(band)
    return df.groupBy(band.cast("bigint").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.sum(F.when((F.col("y") == 1) & (F.col("hit") == 0), 1).otherwise(0)).alias("missed"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two label columns, null labels left out; kappa is the agreement where one class is all there is."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = pairs.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), pairs.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    t = pairs.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    e = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return t.crossJoin(e).select("n", po.alias("agreement"), F.when(pe == 1, po).otherwise((po - pe) / (1 - pe)).alias("kappa"))  # two one-row tables


def auto_rate(df: DataFrame, trust: float = 75.0, threshold: float = 0.5) -> DataFrame:
    """(n, auto, rate, recall) of the rows whose score is above `trust`: their share, and the recall among them (0
    where they hold no positive). df: score, y, p."""
    auto = F.col("score") > trust
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    a = df.agg(F.count(F.lit(1)).alias("n"), n(auto).alias("auto"), n(auto & (F.col("y") == 1)).alias("pos"), n(auto & (F.col("y") == 1) & (F.col("p") >= threshold)).alias("hit"))
    return a.select("n", "auto", F.when(F.col("n") > 0, F.col("auto") / F.col("n")).otherwise(0.0).alias("rate"), F.when(F.col("pos") > 0, F.col("hit") / F.col("pos")).otherwise(0.0).alias("recall"))


def override_count(df: DataFrame, flags: list[str], least: float = 0.7) -> DataFrame:
    """(n, overridden): rows of a probability above `least` on which any of the flags is set; null flags are not."""
    hit = F.lit(False)
    for f in flags:
        hit = hit | (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) != 0)
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((hit & (F.col("p") > least)).cast("bigint")), F.lit(0)).alias("overridden"))
