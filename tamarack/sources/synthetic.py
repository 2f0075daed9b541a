"""Invented mails from templates, the same for the same seed whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .readers import complete

#: (label, subtype, subject, body); {name}, {firm}, {amount}, {code} and {link} are filled in
TEMPLATES = [
    ("phishing", "credential", "Action on your {firm} account {code}", "Dear {name}, your {firm} account was locked. Open {link} to unlock it. Code {code}."),
    ("phishing", "invoice", "Unpaid bill {code} over {amount}", "Hello {name}, the bill {code} over {amount} is late. Pay at {link} today."),
    ("phishing", "parcel", "Parcel {code} is held", "Dear {name}, parcel {code} waits for a fee of {amount}. Confirm at {link}."),
    ("phishing", "payroll", "Change of your pay account", "{name}, confirm the new pay account with {firm} at {link}, case {code}."),
    ("spam", "offer", "{firm} sale: {amount} off", "Hi {name}, {firm} takes {amount} off all orders this week, see {link}. Voucher {code}."),
]
NAMES = ["Ada", "Bo", "Cleo", "Dov", "Esme", "Finn", "Greta", "Hal"]
FIRMS = ["Northgate", "Bluebarn", "Tallow", "Ferrous", "Quillstone"]
ENDINGS = [".example", ".test", ".invalid"]


def generate(spark: SparkSession, plan: dict[str, int], seed: int = 42, attempts: int = 10) -> DataFrame:
    """Records, augmented, as many of each label as the plan asks: `attempts` times as many are drawn and made unique by
    id, and of each label the first by draw are kept. Every value is a hash of seed and draw number."""
    out = None
    for label, n in plan.items():
        mine = [t for t in TEMPLATES if t[0] == label]
        pick = lambda what, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(seed), F.lit(label), F.lit(what), F.col("id")), F.lit(len(xs))) + 1).cast("int"))  # noqa: B023, E731
        number = lambda what, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(label), F.lit(what), F.col("id")), F.lit(most)).cast("string")  # noqa: B023, E731
        rows = spark.range(n * attempts).withColumnRenamed("id", "id")
        slots = {"{name}": pick("name", NAMES), "{firm}": pick("firm", FIRMS), "{amount}": F.concat(number("amount", 900), F.lit(".50")), "{code}": number("code", 1_000_000), "{link}": F.concat(F.lit("http://"), F.lower(pick("host", FIRMS)), pick("end", ENDINGS), F.lit("/"), number("page", 1000))}
        rows = rows.withColumn("k", pick("template", range(len(mine))))

        def filled(part: int):
            t = F.element_at(F.array(*[F.lit(x[part]) for x in mine]), F.col("k") + 1)  # noqa: B023
            for slot, value in slots.items():  # noqa: B023
                t = F.replace(t, F.lit(slot), value)
            return t

        made = rows.select(F.col("id").alias("draw"), filled(2).alias("subject"), filled(3).alias("body_text"), F.element_at(F.array(*[F.lit(x[1]) for x in mine]), F.col("k") + 1).alias("subtype"))
        first = made.groupBy(T.mail_id(F.col("subject"), F.col("body_text")).alias("mail")).agg(F.min_by(F.struct("draw", "subject", "body_text", "subtype"), "draw").alias("x")).select("x.*")
        one = first.orderBy("draw").limit(n).select("subject", "body_text", "subtype", F.lit(label).alias("label"), F.lit("synthetic").alias("source"), F.lit("recent").alias("era_bucket"), F.lit(True).alias("augmented"))
        out = one if out is None else out.union(one)
    return complete(out)
