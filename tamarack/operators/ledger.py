"""State that persists: the ledger of reports, the memory of verdicts, and what training takes from them.

Both are tables that grow by whole batches (storage.BatchTable): a write is atomic, a repeated write of the same batch
changes nothing, and the current state is a combined maximum over the batches, never a rewrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import BatchTable
from . import campaigns

REPORT = """email_id string, received_at timestamp, id bigint, model_version string, subject string, body_text string, features map<string,double>, predicted_label string,
spam_prob double, phishing_prob double, trust_score double, routed_to_review int, reasons array<string>, campaign_cluster_id string, sender_address string"""
#: what a later report of the same mail changes; version, features and reasons stay those of the first
CHANGED = ["received_at", "id", "subject", "body_text", "predicted_label", "spam_prob", "phishing_prob", "trust_score", "routed_to_review", "campaign_cluster_id", "sender_address"]
SIGNATURE = "cluster_id string, simhash string, normalized_subject string, sender_domain string, verdict string, analyst_id string, notes string, learned_at string, seq bigint"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("map<string,double>", "m").replace("\n", " ").split(", ")]


class Ledger:
    """The log of reports, one state a mail."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path)

    def events(self) -> DataFrame:
        return self.table.read("reports", REPORT)

    def save(self, batch: str, reports: DataFrame, cluster: Column | None = None) -> bool:
        """Upserts reports by email_id. A report without a cluster id keeps the one stored for its mail, else the first
        one given for it in the batch, else takes `cluster`, which by default is the computed campaign id.

        Null mail ids are left out; a batch that was saved before is not saved again.
        """
        if batch in self.table.batches():
            return False
        rows = reports.where("email_id is not null")
        given = F.nullif(F.col("campaign_cluster_id"), F.lit(""))
        if cluster is None:
            made = campaigns.campaign_ids(rows, "id", "subject", "body_text", "sender_address").withColumnRenamed("campaign_id", "__made")
            rows, cluster = rows.join(made, "id"), F.col("__made")
        old = self.state().select("email_id", F.col("campaign_cluster_id").alias("__old"))
        first = rows.where(given.isNotNull()).groupBy("email_id").agg(F.min_by("campaign_cluster_id", F.struct("received_at", "id")).alias("__first"))
        rows = rows.join(old, "email_id", "left").join(first, "email_id", "left")
        rows = rows.withColumn("campaign_cluster_id", F.coalesce(given, F.nullif(F.col("__old"), F.lit("")), F.col("__first"), cluster))
        return self.table.append(batch, reports=rows.select(*names(REPORT)))

    def state(self) -> DataFrame:
        """The current row of each mail: the first report's version, features and reasons, the latest one's other fields."""
        kept = [c for c in names(REPORT) if c not in CHANGED and c != "email_id"]
        order = F.struct("received_at", "id")
        by = self.events().groupBy("email_id").agg(F.max_by(F.struct(*CHANGED), order).alias("new"), F.min_by(F.struct(*kept), order).alias("old"))
        return by.select("email_id", *[F.col(f"new.{c}" if c in CHANGED else f"old.{c}").alias(c) for c in names(REPORT) if c != "email_id"])

    def find(self, email_id: str) -> DataFrame:
        """The current row of one mail: the filter reaches the files."""
        kept = self.events().where(F.col("email_id") == email_id)
        return campaigns.latest(kept)


class Memory:
    """Verdicts by campaign. A later verdict on a campaign replaces the earlier one; its fingerprint stays the first's."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = BatchTable(spark, path)

    def remember(self, batch: str, signatures: DataFrame) -> bool:
        """signatures: the columns of SIGNATURE; seq orders them. Verdicts are kept in lower case, trimmed."""
        clean = signatures.where("cluster_id is not null").withColumn("verdict", F.lower(F.trim("verdict")))
        return self.table.append(batch, signatures=clean.select(*names(SIGNATURE)))

    def entries(self) -> DataFrame:
        rows = self.table.read("signatures", SIGNATURE)
        first, last = ["simhash", "normalized_subject", "sender_domain"], ["verdict", "analyst_id", "notes", "learned_at"]
        by = rows.groupBy("cluster_id").agg(F.min_by(F.struct(*first), "seq").alias("f"), F.max_by(F.struct(*last), "seq").alias("l"), F.min("seq").alias("seq"))
        return by.select("cluster_id", *[F.col(f"f.{c}").alias(c) for c in first], *[F.col(f"l.{c}").alias(c) for c in last], "seq")

    def lookup(self, mails: DataFrame, bits: int = 5) -> DataFrame:
        """See campaigns.recall_verdicts; stored hashes are hexadecimal text."""
        return campaigns.recall_verdicts(mails, self.entries().withColumn("simhash", campaigns.from_hex16(F.col("simhash"))), bits)

    def hit(self, batch: str, found: DataFrame) -> bool:
        """Counts the matches of a lookup, (cluster_id) a row, under the batch's name."""
        return self.table.append(f"hits-{batch}", hits=found.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")))

    def stats(self) -> DataFrame:
        """(cluster_id, verdict, hit_count) of every entry."""
        n = self.table.read("hits", "cluster_id string, n bigint").groupBy("cluster_id").agg(F.sum("n").alias("n"))
        return self.entries().select("cluster_id", "verdict").join(n, "cluster_id", "left").select("cluster_id", "verdict", F.coalesce("n", F.lit(0)).alias("hit_count"))

    def clear(self) -> None:
        self.table.clear()


def ref_key(subject: Column) -> Column:
    """The reference in a subject by which copies of one mail are known; an empty string without one."""
    return F.lower(F.regexp_extract(T.text(subject), r"(?i)(REF-\d+|wire-auth-\d+|Ref\s*#\d+)", 1))


def message_key(message_id: Column) -> Column:
    return F.lower(F.trim(F.btrim(T.text(message_id), F.lit("<>"))))


def feed(mails: DataFrame, newest: Column) -> DataFrame:
    """One row of each mail, the newest: mails are the same by Message-ID or, without one (or a live- one), by reference.
    Mails with neither all stay. mails: message_id, subject; newest: an order whose largest value wins."""
    mid = message_key(F.col("message_id"))
    key = F.when((mid != "") & ~mid.startswith("live-"), F.concat(F.lit("m:"), mid)).when(ref_key(F.col("subject")) != "", F.concat(F.lit("r:"), ref_key(F.col("subject"))))
    rows = mails.withColumn("__key", key)
    best = rows.where("__key is not null").groupBy("__key").agg(F.max_by(F.struct(*mails.columns), newest).alias("x")).select("x.*")
    return best.unionByName(rows.where("__key is null").drop("__key"))


def not_stored(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched mails whose Message-ID and reference are both new: two anti joins on keys."""
    f = fetched.withColumns({"__m": message_key(F.col("message_id")), "__r": ref_key(F.col("subject"))})
    m = stored.select(message_key(F.col("message_id")).alias("__m")).where("__m <> ''").distinct()
    r = stored.select(ref_key(F.col("subject")).alias("__r")).where("__r <> ''").distinct()
    return f.join(m, "__m", "left_anti").join(r, "__r", "left_anti").drop("__m", "__r")


def retrain_set(train: DataFrame, labelled: DataFrame, labels: tuple[str, ...] = ("spam", "phishing"), columns: list[str] | None = None) -> DataFrame:
    """Training rows and, below them, judged reports: those with features and a known label, each model column read from
    the features (0 where absent); joined by name on the columns that train has. Rows of other labels leave."""
    judged = labelled.where(F.col("features").isNotNull() & (F.size("features") > 0) & F.col("label").isin(*labels))
    judged = judged.withColumns({c: F.coalesce(F.try_element_at("features", F.lit(c)), F.lit(0.0)) for c in columns or []})
    common = [c for c in train.columns if c in judged.columns]
    return train.unionByName(judged.select(*common), allowMissingColumns=True).where(F.col("label").isin(*labels))

