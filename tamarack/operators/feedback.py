"""The ledger of reports and verdicts: current state, searches, summaries. Timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import campaigns

LAST_CALL = ("Defer",)


def dashboard(log: DataFrame) -> DataFrame:
    """All counts of the overview in one aggregate, rates in percent with one decimal."""
    n = lambda c: F.coalesce(F.sum(F.expr(f"case when {c} then 1 else 0 end")), F.lit(0))
    a = log.agg(
        F.count(F.lit(1)).alias("total"), n("predicted_label = 'phishing'").alias("phishing"), n("predicted_label = 'spam'").alias("spam"), n("routed_to_review = 1").alias("routed"),
        n("routed_to_review = 1 and analyst_label is null").alias("pending"), n("analyst_label is not null").alias("reviewed"), n("agreement = 1").alias("agreed"), n("agreement = 0").alias("overridden"),
        n("analyst_label = 'Defer'").alias("deferred"), n("predicted_label = 'legitimate_benign' or analyst_label in ('benign', 'legitimate')").alias("benign"))
    judged = F.col("agreed") + F.col("overridden")
    pct = lambda c, d: F.round(F.when(judged > 0, c / judged).otherwise(d) * 100, 1)
    return a.select("*", pct(F.col("agreed"), 1.0).alias("agreement_rate"), pct(F.col("overridden"), 0.0).alias("override_rate"))


def workload(log: DataFrame) -> DataFrame:
    """Pending reports against pending campaigns and what was settled without an analyst."""
    pend = "routed_to_review = 1 and analyst_label is null"
    key = F.coalesce(F.when(F.col("campaign_cluster_id") != "", F.col("campaign_cluster_id")), F.col("email_id"))
    a = log.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.expr(f"case when {pend} then 1 else 0 end")), F.lit(0)).alias("pending"),
                F.coalesce(F.sum(F.expr("case when routed_to_review = 0 then 1 else 0 end")), F.lit(0)).alias("auto"), F.count_distinct(F.when(F.expr(pend), key)).alias("campaigns"))
    p, c, t = F.col("pending"), F.col("campaigns"), F.col("total")
    return a.select("total", "pending", "campaigns", "auto", F.round(F.when(p > 0, p / F.greatest(c, F.lit(1))).otherwise(1.0), 1).alias("compression"),
                    F.round(F.when(p > 1, (1 - c / p) * 100).otherwise(0.0), 1).alias("effort_saved"), F.round(F.when(t > 0, F.col("auto") / t * 100).otherwise(0.0), 1).alias("deflection"))


def override_rate(log: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """(reviewed, overrides, agreements, rate) of the verdicts of the last days before `now`, the latest verdict where
    none is given; the deferring label is left out, as it is spelled."""
    if now is None:
        log = log.crossJoin(log.agg(F.max("reviewed_at").alias("__now")))  # a one-row table
        now = F.col("__now")
    w = log.where(F.col("reviewed_at").isNotNull() & (F.col("reviewed_at") >= now - F.expr(f"interval {days} days")) & F.col("analyst_label").isNotNull() & ~F.col("analyst_label").isin(*LAST_CALL))
    a = w.agg(F.count(F.lit(1)).alias("reviewed"), F.coalesce(F.sum((F.col("agreement") == 0).cast("bigint")), F.lit(0)).alias("overrides"), F.coalesce(F.sum((F.col("agreement") == 1).cast("bigint")), F.lit(0)).alias("agreements"))
    return a.select("*", F.when(F.col("reviewed") > 0, F.col("overrides") / F.col("reviewed")).otherwise(0.0).alias("rate"))


def traffic(log: DataFrame, days: int = 7) -> DataFrame:
    """The mix of the last days of reports before the latest one; an empty window gives zeros and a mean of 100."""
    now = log.agg(F.max("received_at").alias("__now"))
    w = log.crossJoin(now).where(F.col("received_at") >= F.col("__now") - F.expr(f"interval {days} days"))
    pct = lambda c: F.coalesce(F.round(F.avg(F.expr(f"case when {c} then 1.0D else 0.0D end")) * 100, 1), F.lit(0.0))
    return w.agg(F.count(F.lit(1)).alias("reports"), pct("predicted_label = 'phishing'").alias("phishing_pct"), pct("predicted_label = 'spam'").alias("spam_pct"), pct("routed_to_review = 1").alias("review_pct"), F.coalesce(F.round(F.avg("trust_score"), 1), F.lit(100.0)).alias("avg_trust"))


STATUS = {"pending": "routed_to_review = 1 and analyst_label is null", "agreed": "agreement = 1", "overridden": "agreement = 0", "reviewed": "analyst_label is not null", "review_needed": "routed_to_review = 1"}


def search(log: DataFrame, words: str = "", label: str = "", status: str = "") -> DataFrame:
    """Rows that hold the words (LIKE, any letter case) in one of five columns, of a label and a status."""
    if words:
        hit = F.lit(False)
        for c in ("subject", "body_text", "sender_address", "email_id", "campaign_cluster_id"):
            hit = hit | F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False))
        log = log.where(hit)
    if label:
        log = log.where(F.col("predicted_label") == label)
    return log.where(STATUS[status]) if status else log


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an order that ends in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def queue(log: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Pending reports, least trusted first."""
    return page(log.where(STATUS["pending"]), [F.col("trust_score").asc_nulls_first(), F.col("id")], limit, offset)


def campaign_queue(log: DataFrame, limit: int) -> DataFrame:
    """Pending campaigns, largest first, then least trusted."""
    return page(campaigns.rollup(log), [F.desc("reports"), F.asc("min_trust"), F.asc("cluster_id")], limit)


def with_verdicts(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The log with the latest verdict of each mail laid over it; agreement compares the labels in lower case."""
    last = verdicts.groupBy("email_id").agg(F.max_by(F.struct("analyst_label", "analyst_id", "notes", "reviewed_at"), F.struct("reviewed_at", "verdict_id")).alias("v"))
    j = log.join(last, "email_id", "left")
    has = F.col("v").isNotNull()
    pick = lambda c: F.when(has, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c)
    agree = F.when(has, (F.lower(F.col("v.analyst_label")) == F.lower(F.col("predicted_label"))).cast("int")).otherwise(F.col("agreement")).alias("agreement")
    return j.select(*[pick(c) if c in ("analyst_label", "analyst_id", "notes", "reviewed_at") else agree if c == "agreement" else F.col(c) for c in log.columns])


def bulk_verdict(log: DataFrame, cluster: str, label: str, analyst: str, at: Column) -> DataFrame:
    """The log with one verdict on all unreviewed rows of a cluster."""
    hit = (F.col("campaign_cluster_id") == cluster) & F.col("analyst_label").isNull()
    new = {"analyst_label": F.lit(label), "analyst_id": F.lit(analyst), "reviewed_at": at, "agreement": (F.lower(F.lit(label)) == F.lower(F.col("predicted_label"))).cast("int")}
    return log.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def labelled(log: DataFrame) -> DataFrame:
    """Rows with a final verdict, label in lower case, subject kept, for training."""
    return log.where("analyst_label is not null and analyst_label <> 'Defer'").select("email_id", "subject", "body_text", "features", F.lower("analyst_label").alias("label"))


def hits(log: DataFrame, cache: DataFrame) -> DataFrame:
    """(cluster_id, hits) of every cached cluster; the count is combined before the join."""
    n = log.groupBy(F.col("campaign_cluster_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("hits"))
    return cache.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def ranked_quantiles(df: DataFrame, col: str, points: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """The values at sorted positions floor(n * point): from counts by value, so a task holds distinct values at most
    of one of 256 ranges."""
    by = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    lo, hi, total = by.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if total is None:
        return df.sparkSession.createDataFrame([], "point double, value double")
    width = (hi - lo) / 256 or 1.0
    r = by.withColumn("r", F.least(F.floor((F.col("v") - lo) / width), F.lit(255)).cast("int"))
    base = r.groupBy("r").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most 256 rows
    at = r.join(F.broadcast(base.select("r", "before")), "r").withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("r").orderBy("v")))
    rows = [at.where(F.col("upto") > int(total * p)).agg(F.min("v").cast("double").alias("value")).select(F.lit(p).alias("point"), "value") for p in points]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out
