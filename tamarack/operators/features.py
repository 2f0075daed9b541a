"""The mail features: one projection of built-in expressions, so a scan computes them without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as T
from ..storage import spread

PUNCTUATION = r"!-/:-@\[-`{-~"
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"


def sender_features() -> dict[str, Column]:
    d = T.domain(F.col("sender_address"))
    words = T.tokens(F.regexp_replace(F.lower(T.text("sender_display_name")), "@", " "))
    first = F.filter(words, lambda w: w.contains(".") & (F.length(w) > 4))
    shown = F.btrim(F.when(F.size(first) > 0, F.get(first, F.lit(0))).otherwise(""), F.lit(".,<>"))
    reply = T.text("reply_to")
    rd = T.domain(F.col("reply_to"))
    return {
        "display_from_mismatch": (shown != "") & (shown != d),
        "reply_to_mismatch": (reply != "") & (rd != "") & (rd != d),
        "free_email_sender": d.isin(L.FREE_MAIL),
    }


def _entropy(name: Column) -> Column:
    """Shannon entropy of the first label of a host, rounded terms in the order of the characters."""
    label = F.when(name.contains("."), F.substring_index(name, ".", 1)).otherwise(name)
    chars = F.filter(F.split(label, ""), lambda c: c != "")
    n = F.length(label).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
    return F.when(label == "", F.lit(0.0)).otherwise(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))


def _squats(h: Column) -> Column:
    """A brand hits if it is two edits away or a leading label; a brand that equals the domain ends the list."""
    folded = F.translate(F.lower(h), "аеорсх", "aeopcx")
    parts = F.split(folded, r"\.")
    reg = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(folded)
    exact = F.array_position(F.array(*[F.lit(b) for b in L.BRAND_DOMAINS]), reg)
    hits = [(F.lit(i + 1) < F.when(exact == 0, F.lit(10**6)).otherwise(exact)) & ((F.levenshtein(reg, F.lit(b), 2) >= 0) | folded.startswith(b + ".")) for i, b in enumerate(L.BRAND_DOMAINS)]
    out = hits[0]
    for x in hits[1:]:
        out = out | x
    return out


def urls_column() -> Column:
    return F.coalesce(F.col("urls"), F.array().cast("array<string>"))


def hosts_of(urls: Column) -> Column:
    """The distinct hosts of URLs, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(urls, T.host), lambda h: h != "")))


def url_features(hosts: Column | None = None) -> dict[str, Column]:
    urls = urls_column()
    hosts = hosts_of(urls) if hosts is None else hosts
    short = lambda h: h.isin(L.SHORTENERS) | F.rlike(h, F.lit("(?:" + "|".join(r"\." + s.replace(".", r"\.") for s in L.SHORTENERS) + ")$"))
    tld = lambda h: F.rlike(h, F.lit("(?:" + "|".join(t.replace(".", r"\.") for t in L.SUSPICIOUS_TLDS) + ")$"))
    total = F.aggregate(F.transform(hosts, _entropy), F.lit(0.0), lambda a, x: a + x)
    return {
        "url_count": F.size(urls).cast("bigint"),
        "domain_count": F.size(hosts).cast("bigint"),
        "shortened_url_present": F.exists(hosts, short),
        "suspicious_tld_present": F.exists(hosts, tld),
        "ip_literal_url": F.exists(hosts, lambda h: F.rlike(h, F.lit(r"^(\d{1,3}\.){3}\d{1,3}$"))),
        "url_entropy": F.when(F.size(hosts) > 0, total / F.size(hosts)).otherwise(F.lit(0.0)),
        "typosquatting_detected": F.exists(hosts, _squats),
    }


def attachment_features() -> dict[str, Column]:
    files = F.coalesce(F.col("attachments"), F.array().cast("array<struct<filename:string,mime_type:string>>"))

    def kind(a: Column) -> Column:
        name, mime = T.text(a["filename"]), F.lower(T.text(a["mime_type"]))
        ext = F.when(name.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise("")
        return (F.when(ext.isin(L.EXECUTABLE_EXT) | mime.contains("executable") | mime.contains("x-msdownload"), "executable")
                .when(ext.isin(L.MACRO_EXT) | mime.contains("macro"), "macro").when(ext.isin(L.ARCHIVE_EXT) | mime.contains("zip") | mime.contains("compressed"), "archive")
                .when(mime.contains("pdf") | (ext == ".pdf"), "pdf").when(mime.contains("office") | ext.isin(L.OFFICE_EXT), "office").otherwise("other"))

    kinds = F.array_sort(F.array_distinct(F.transform(files, kind)))
    return {
        "has_attachment": F.size(files) > 0,
        "attachment_type": F.array_join(kinds, ","),
        "executable_detected": F.array_contains(kinds, "executable"),
        "macro_detected": F.array_contains(kinds, "macro"),
    }


def text_features() -> dict[str, Column]:
    body = T.text("body_text")
    n = F.length(body).cast("double")
    ratio = lambda chars: F.when(n > 0, T.count_of(body, chars) / n).otherwise(F.lit(0.0))
    words = F.size(T.tokens(body))
    return {
        "subject_length": F.length(T.text("subject")).cast("bigint"),
        "body_length": F.length(body).cast("bigint"),
        "uppercase_ratio": ratio(r"\p{Lu}"),
        "digit_ratio": ratio(DIGITS),
        "punctuation_density": ratio(PUNCTUATION),
        "link_density": F.when(words > 0, F.regexp_count(body, F.lit("https?://")) / words).otherwise(F.lit(0.0)),
    }


def low_text() -> Column:
    return F.lower(F.concat(T.text("subject"), F.lit(" "), T.text("body_text")))


def first_brand(body: Column, d: Column) -> Column:
    """The first listed brand that a lower-cased text names or whose domain the sender's holds; null without one."""
    first = F.lit(None).cast("string")
    for b in reversed(L.BRAND_DOMAINS):
        first = F.when(body.contains(b.split(".")[0]) | d.contains(b), F.lit(b)).otherwise(first)
    return first


def brand_features(first: Column | None = None, d: Column | None = None) -> dict[str, Column]:
    d = T.domain(F.col("sender_address")) if d is None else d
    first = first_brand(low_text(), d) if first is None else first
    return {"brand_mention": first.isNotNull(), "sender_brand_mismatch": F.coalesce(~d.contains(first) & ~first.contains(d), F.lit(False))}


def missing_count() -> Column:
    return (F.when(T.text("sender_address") == "", 3).otherwise(0) + F.when(T.text("body_text") == "", 4).otherwise(0)).cast("bigint")


def features(emails: DataFrame, keep: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The 21 features, the attachment types and the count of missing ones. What several of them read (hosts, the
    lower-cased text, the sender's domain, the brand) is computed once, in projections before."""
    base = spread(emails).withColumns({"__hosts": hosts_of(urls_column()), "__low": low_text(), "__domain": T.domain(F.col("sender_address"))})
    base = base.withColumn("__brand", first_brand(F.col("__low"), F.col("__domain")))
    cols = sender_features() | url_features(F.col("__hosts")) | attachment_features() | text_features() | brand_features(F.col("__brand"), F.col("__domain")) | {"missing_feature_count": missing_count()}
    return base.select(*keep, *[c.alias(n) for n, c in cols.items()])


def vector_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The model columns as doubles: absent, null and NaN ones are 0."""
    names = names or L.FEATURE_VECTOR
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in have else F.lit(0.0) for c in names})
