"""Column functions over mail text, addresses and URLs. All run inside the JVM; nulls count as empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
TOKEN = r"[^\s\p{Z}\x1c-\x1f\x85]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def count_of(c: Column, chars: str) -> Column:
    """Number of characters of a class given as the inside of a bracket expression."""
    return F.length(F.regexp_replace(c, f"[^{chars}]", ""))


def tokens(c: Column) -> Column:
    """Runs between Unicode white space."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def domain(c: Column) -> Column:
    """Text after the last @ where there is no slash, else the host of an http URL, else the input; lower case."""
    a = F.lower(F.trim(text(c)))
    host = F.split(F.regexp_extract(a, r"https?://([^/?\s]+)", 1), ":")[0]
    return F.when(a.contains("@") & ~a.contains("/"), F.substring_index(a, "@", -1)).when(host != "", host).otherwise(a)


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) URL without user part and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^@/?#]*@)?(\[[^\]]+\]|[^:/?#]*)", 1))


def urls_of(c: Column) -> Column:
    """http(s) URLs in order, repeats kept."""
    return F.regexp_extract_all(text(c), F.lit(r"https?://[^\s<>\"']+"), F.lit(0))


def mailbox_urls(c: Column) -> Column:
    """http(s) URLs as mailboxes show them: a backslash ends one too."""
    return F.regexp_extract_all(text(c), F.lit(r"https?://[^\s<>\"'\\]+"), F.lit(0))


def root_domain(address: Column) -> Column:
    """Registered domain of an address: two labels, three below a second-level registry label."""
    a = text(address)
    found = F.regexp_extract(a, r"[\w.-]+@([\w.-]+\.[a-zA-Z]{2,})", 1)
    rest = F.btrim(F.substring_index(a, "@", -1), F.lit("<>\"' \t\r\n"))
    d = F.lower(F.when(found != "", found).otherwise(rest))
    parts = F.split(d, r"\.")
    n = F.size(parts)
    three = (n >= 3) & F.try_element_at(parts, F.lit(-2)).isin(L.SECOND_LEVEL)
    return (F.when(~a.contains("@"), "unknown_domain").when(three, F.array_join(F.slice(parts, -3, 3), "."))
            .when(n >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(d))


def label_of(c: Column) -> Column:
    """spam, phishing or an empty string."""
    x = F.lower(F.trim(text(c)))
    return F.when(x.isin(L.SPAM_LABELS), "spam").when(x.isin(L.PHISHING_LABELS), "phishing").otherwise("")


def era_of(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year < 2010, "legacy").when(year < 2018, "mid").otherwise("recent")


def mail_id(subject: Column, body: Column) -> Column:
    """sha256 of the subject and the first 500 characters of the body."""
    return F.sha2(F.concat(text(subject), F.substring(text(body), 1, 500)), 256)


def model_text(subject: Column, body: Column) -> Column:
    return F.concat(text(subject), F.lit(" [SEP] "), text(body))


def body_key(c: Column) -> Column:
    """sha256 of the lower-cased text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text(c)), f"{SPACE}+", " ")), 256)


def html_text(c: Column) -> Column:
    """Text of an HTML part; the part itself where nothing is left."""
    bare = F.btrim(F.regexp_replace(text(c), r"<[^>]+>", " "))
    return F.when(bare != "", bare).otherwise(text(c))


def snippet(c: Column) -> Column:
    """The first 22 tokens, cut at 140 characters."""
    s = F.array_join(F.slice(tokens(text(c)), 1, 22), " ")
    return F.when(F.length(s) > 140, F.concat(F.substring(s, 1, 140), F.lit("..."))).otherwise(s)


def source_rank(c: Column) -> Column:
    """Quality rank by the first listed name that the source holds; 0 is best."""
    s = F.lower(text(c))
    rank = F.lit(len(L.SOURCE_QUALITY))
    for i in range(len(L.SOURCE_QUALITY) - 1, -1, -1):
        rank = F.when(s.contains(L.SOURCE_QUALITY[i]), i).otherwise(rank)
    return rank


_W = r"[\p{L}\p{N}_]"
_NW = rf"(?<!{_W})"


def cluster_text(c: Column) -> Column:
    """A body with what varies between copies of one campaign made uniform."""
    t = F.lower(text(c))
    for pattern, put in (
        (rf"[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.{_W}+", "<EMAIL>"),
        (rf"https?://{TOKEN}", "<URL>"),
        (rf"{_NW}(?:dear|hi|hello|greetings|good morning|good afternoon){SPACE}+[\p{{L}}\p{{N}}_\s\p{{Z}}]{{1,30}}?[,\n:]", "<GREETING> "),
        (rf"{_NW}(?:tracking|order|ticket|ref|reference|id|case|account)[\s\p{{Z}}#:]+[a-z0-9_-]+(?!{_W})", "<REF_ID>"),
        (rf"{_NW}\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{2,4}}(?!{_W})", "<DATE>"),
        (rf"{_NW}(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*{SPACE}+\p{{Nd}}{{1,2}},?{SPACE}+\p{{Nd}}{{4}}(?!{_W})", "<DATE>"),
        (rf"{_NW}\p{{Nd}}+(?!{_W})", "<NUM>"),
        (r"[^\p{L}\p{N}_\s\p{Z}<>]", " "),
        (f"{SPACE}+", " "),
    ):
        t = F.regexp_replace(t, pattern, put)
    return F.trim(t)


def cluster_subject(c: Column) -> Column:
    """A subject without reply marks, bracketed tags and trailing references; the strips run until nothing changes.
    Each pass that changes a subject shortens it, so its length bounds the passes; the rest are skipped."""
    s = F.btrim(F.lower(text(c)))
    s = F.btrim(F.regexp_replace(s, rf"^(?:(?:re|fwd|fw|external|notice|urgent|action required|important)[\s\p{{Z}}:;\-\]]+)+", ""))

    def strip(s: Column) -> Column:
        s = F.btrim(F.regexp_replace(s, r"\[.*?\]|\(.*?\)", ""))
        s = F.btrim(F.regexp_replace(s, r"[\s\-_|:]+(?:account|ref|reference|case|ticket|order|inv|invoice|id|batch|num|number)[\s#:]*[\p{L}\p{N}_\-]*\s*$", ""))
        return F.btrim(F.regexp_replace(s, r"[\s\-_#:]+[a-f0-9\-]{3,}\s*$", ""))

    start = F.struct(s.alias("s"), F.lit(False).alias("done"))
    again = lambda x: F.when(x["done"], x).otherwise(F.transform(F.array(strip(x["s"])), lambda y: F.struct(y.alias("s"), (y == x["s"]).alias("done")))[0])
    s = F.aggregate(F.sequence(F.lit(0), F.length(s)), start, lambda x, _: again(x), lambda x: x["s"])
    s = F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" \t\n\r-_:|#"))
    return F.when(s == "", "no_subject").otherwise(s)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
