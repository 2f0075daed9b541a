"""Data-set audits: one pass each, wide aggregates turned to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, blanks) of string columns, from one aggregate."""
    cols = [F.struct(F.lit(c).alias("column_name"), F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias("nulls"), F.sum(F.when(F.col(c) == "", 1).otherwise(0)).alias("blanks")) for c in columns]
    return df.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of which null equals null; the columns appear once."""
    r = right.withColumnsRenamed({c: f"__{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(F.col(f"__{c}"))
    return left.join(r, cond, how).drop(*[f"__{c}" for c in on])


def linear_quantiles(rows: DataFrame, by: list[str], points: tuple[float, ...]) -> DataFrame:
    """(by..., points array<double>) of the values v, exact, with linear interpolation; null values are left out.

    Rows become counts by value, the values of a group 256 ranges with the count before each, so a task holds the
    distinct values of one range at most, never a group's.
    """
    by_value = rows.where("v is not null").select(*by, F.col("v").cast("double").alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    ends = by_value.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 256).otherwise(1.0)
    ranged = null_safe(by_value, ends, by).withColumn("r", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(255)).cast("int"))
    size = ranged.groupBy(*by, "r").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(*by).orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most 256 rows a group
    at = null_safe(ranged, size.withColumn("before", before).drop("m"), [*by, "r"])
    at = at.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*by, "r").orderBy("v")))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    value = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    cols = [x for i, p in enumerate(points) for x in (value(F.floor(place(p))).alias(f"a{i}"), value(F.ceil(place(p))).alias(f"b{i}"), F.max(place(p) - F.floor(place(p))).alias(f"f{i}"))]
    return at.groupBy(*by).agg(*cols).select(*by, F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(points))]).alias("points"))


def _long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keep, "x.*")


def describe(df: DataFrame, columns: list[str], points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(column_name, n, mean, sd, least, p1 ... p99, most) with exact linear percentiles; a column of nulls has n = 0."""
    long = _long(df, columns, [])
    base = long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))
    q = linear_quantiles(long, ["column_name"], points)
    return base.join(q, "column_name", "left").select("column_name", "n", "mean", "sd", "least", *[F.get("points", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(points)], "most")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n), null values included: one expand, one combined count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))


def boolean_rates(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Share of true of each column, as `rate`, in rows; by: one row for each of its values as well."""
    rates = F.array(*[F.struct(F.lit(c).alias("column_name"), F.avg(F.col(c).cast("int")).alias("rate")) for c in columns])
    agg = (df.groupBy(by) if by else df.groupBy()).agg(rates.alias("x"))
    return agg.select(*([by] if by else []), F.explode("x").alias("x")).select(*([by] if by else []), "x.*")


def split_overlap(df: DataFrame, body: str = "body_text") -> DataFrame:
    """(left_split, right_split, bodies): distinct normalised bodies that two splits share."""
    keys = df.where("split in ('train', 'val', 'test')").select(T.body_key(F.col(body)).alias("k"), "split")
    seen = keys.groupBy("k").agg(F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") == "val").alias("v"), F.max(F.col("split") == "test").alias("e"))
    pairs = (("train", "val", F.col("t") & F.col("v")), ("train", "test", F.col("t") & F.col("e")), ("val", "test", F.col("v") & F.col("e")))
    x = seen.agg(F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias("bodies")) for a, b, c in pairs]).alias("x"))
    return x.select(F.explode("x").alias("x")).select("x.*")


def numeric_drift(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, split, mean, median)."""
    long = _long(df, columns, ["split"])
    mean = long.groupBy("column_name", "split").agg(F.avg("v").alias("mean"))
    mid = linear_quantiles(long, ["column_name", "split"], (0.5,)).select("column_name", "split", F.get("points", F.lit(0)).alias("median"))
    return null_safe(mean, mid, ["column_name", "split"], "left").select("column_name", "split", "mean", "median")


def consistency(df: DataFrame) -> DataFrame:
    """(check_name, bad) over a feature table joined with its texts."""
    out = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    checks = {
        "attachment_inconsistency": ~F.col("has_attachment") & (F.col("attachment_type") != ""), "body_length_mismatch": F.length(T.text("body_text")) != F.col("body_length"), "subject_length_mismatch": F.length(T.text("subject")) != F.col("subject_length"),
        "digit_ratio_out_of_bounds": out("digit_ratio"), "uppercase_ratio_out_of_bounds": out("uppercase_ratio"), "link_density_out_of_bounds": out("link_density"),
    }
    x = df.agg(F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias("bad")) for n, c in checks.items()]).alias("x"))
    return x.select(F.explode("x").alias("x")).select("x.*")


def coverage(df: DataFrame) -> DataFrame:
    """The counts that data-quality gates read, in one row: labels, sources, augmented share, structural coverage."""
    return df.agg(F.sum((F.col("label") == "spam").cast("bigint")).alias("spam"), F.sum((F.col("label") == "phishing").cast("bigint")).alias("phishing"), F.countDistinct("source").alias("sources"),
                  F.coalesce(F.avg(F.col("augmented").cast("int")), F.lit(1.0)).alias("augmented_share"), F.avg(((T.text("sender_address") != "") & (T.text("body_text") != "")).cast("int")).alias("covered_share"))


# Columns that would tell a model what it is to learn.
LEAKY = ["id", "split", "source", "augmented", "attachment_type", "subtype", "era_bucket"]


def without_leaks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.drop(*(columns or LEAKY))


def good_rows(df: DataFrame, most_missing: int = 3, labels: tuple[str, ...] = ("spam", "phishing")) -> DataFrame:
    """Rows of a known label that miss few features."""
    return df.where((F.col("missing_feature_count") <= most_missing) & F.col("label").isin(*labels))


def without_sources(df: DataFrame, sources: list[str], passed: bool) -> DataFrame:
    """All rows where the audit passed, else those of other sources; a null source is no listed one."""
    return df if passed else df.where(F.coalesce(~F.col("source").isin(*sources), F.lit(True)))


def structural() -> Column:
    """Whether a feature row tells anything of links, sender or text."""
    flags = F.lit(False)
    for c in ("shortened_url_present", "suspicious_tld_present", "display_from_mismatch", "reply_to_mismatch", "free_email_sender"):
        flags = flags | F.coalesce(F.col(c), F.lit(False))
    return (F.col("url_count") > 0) | flags | (F.col("body_length") > 0)


def gates(train: DataFrame, spam: int = 5_000, phishing: int = 6_000, sources: int = 3, synthetic: float = 0.25, coverage: float = 0.5) -> DataFrame:
    """(gate, value, required, passed) of the quality gates and, last, `overall`. train: feature rows with label, source,
    augmented; an empty table has a synthetic share of 1 and no coverage."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("double")
    a = train.agg(n(F.col("label") == "spam").alias("a"), n(F.col("label") == "phishing").alias("b"), F.count_distinct(F.when(F.col("label") == "phishing", F.col("source"))).cast("double").alias("c"),
                  F.coalesce(F.avg(F.coalesce("augmented", F.lit(False)).cast("int")), F.lit(1.0)).alias("d"), F.coalesce(F.avg(structural().cast("int")), F.lit(0.0)).alias("e"))
    row = lambda name, c, need, ok: F.struct(F.lit(name).alias("gate"), F.col(c).alias("value"), F.lit(float(need)).alias("required"), ok.alias("passed"))
    all_ = [row("spam_samples", "a", spam, F.col("a") >= spam), row("phishing_samples", "b", phishing, F.col("b") >= phishing), row("phishing_source_diversity", "c", sources, F.col("c") >= sources),
            row("synthetic_ratio", "d", synthetic, F.col("d") <= synthetic), row("structural_coverage", "e", coverage, F.col("e") > coverage)]
    x = a.select(F.array(*all_).alias("x")).select("x", F.forall("x", lambda g: g["passed"]).alias("ok"))
    passed = F.aggregate("x", F.lit(0.0), lambda acc, g: acc + g["passed"].cast("double"))
    return x.select(F.explode(F.concat("x", F.array(F.struct(F.lit("overall").alias("gate"), passed.alias("value"), F.lit(float(len(all_))).alias("required"), F.col("ok").alias("passed"))))).alias("g")).select("g.*")


# Phrases by which a mail is labelled without a model.
PHISHING_PHRASES = ["verify your", "confirm your", "update your password", "click here to", "your account", "suspended", "unauthorized access", "login", "sign in", "credential", "verify account", "reset your password", "unusual activity"]
SPAM_PHRASES = ["unsubscribe", "click here to unsubscribe", "promotional", "offer", "discount", "sale", "newsletter", "marketing", "advertisement"]


def phrase_vote(subject: str, body: str) -> Column:
    """phishing or spam, whichever has more of its phrases in the text; an empty string on a tie."""
    t = F.lower(F.concat(T.text(subject), F.lit(" "), T.text(body)))
    votes = lambda ps: F.size(F.filter(F.array(*[F.lit(p) for p in ps]), lambda p: t.contains(p)))
    p, s = votes(PHISHING_PHRASES), votes(SPAM_PHRASES)
    return F.when(p > s, "phishing").when(s > p, "spam").otherwise("")
