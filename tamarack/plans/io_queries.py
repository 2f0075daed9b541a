"""Queries of readers and writers: each table is written in the form that the reader reads, below the shared folder,
read back, and compared with the table itself by the SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as T
from ..operators import features
from ..sources import readers, synthetic, writers
from ..storage import workspace
from .registry import _BODY, _list, register

# line ends inside quoted fields may come back as \n
_FLAT = lambda c: f"regexp_replace({c}, '[\\r\\n]+', ' ', 'g')"


def _flat(c: str):
    return F.regexp_replace(F.col(c), r"[\r\n]+", " ")


def _digest(c):
    return F.md5(F.coalesce(c, F.lit("")))


def _csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return path


_NAMES = f"select coalesce(subject, '') as subject, label, md5({_FLAT(_BODY)}) as body from emails"


@register("csv_scan", f"select md5({_FLAT("coalesce(subject, '')")}) as subject, label, md5({_FLAT(_BODY)}) as body, coalesce(reply_to, '') as reply_to from emails")
def _(read):
    e = read("emails")
    path = _csv(e.select(F.col("subject").alias("Title"), F.col("body_text").alias("Email Text"), F.col("label").alias("Class"), F.col("sender_address").alias("From"), F.col("reply_to").alias("Reply-To")), workspace(e.sparkSession, "csv"))
    return readers.read_csv(e.sparkSession, path, "export", max_rows=2**31 - 1).select(_digest(_flat("subject")).alias("subject"), "label", _digest(_flat("body_text")).alias("body"), "reply_to")


@register("csv_default_label", "select case when label = '' then 'spam' else label end as label, count(*) as n from emails group by 1")
def _(read):
    e = read("emails")
    path = _csv(e.select("label", F.lit("x").alias("text")), workspace(e.sparkSession, "csv"))
    return readers.read_csv(e.sparkSession, path, default_label="spam", multi_line=False).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("inverted_csv", f"select 'spam' as label, md5({_FLAT("coalesce(subject, '')")}) as subject, 'mid' as era_bucket from emails where label = 'phishing'")
def _(read):
    e = read("emails")
    path = _csv(e.select("subject", F.col("body_text").alias("body"), F.when(F.col("label") == "phishing", "1").otherwise("0").alias("label")), workspace(e.sparkSession, "csv"))
    return readers.read_inverted_csv(e.sparkSession, path, "inv", 2**31 - 1).select("label", _digest(_flat("subject")).alias("subject"), "era_bucket")


@register("capped_csv", "select case when label = 'phishing' then 'phishing' else 'spam' end as label, least(count(*), 100) as n from emails group by 1")
def _(read):
    e = read("emails")
    path = _csv(e.select(F.col("body_text").alias("text_combined"), F.when(F.col("label") == "phishing", "1").otherwise("0").alias("label")), workspace(e.sparkSession, "csv"))
    return readers.read_capped_csv(e.sparkSession, path, "cap", 200).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("json_lines_scan", f"select coalesce(nullif(id, ''), sha256(coalesce(subject, '') || substr({_BODY}, 1, 500))) as id, md5({_BODY}) as body, label, source, era_bucket, augmented, len(case when len(coalesce(urls, [])) > 0 then urls else regexp_extract_all({_BODY}, 'https?://[^\\s<>\"'']+') end)::bigint as urls from emails")
def _(read):
    e = read("emails")
    path = workspace(e.sparkSession, "lines")
    writers.write_lines(e.select("id", "subject", F.col("body_text").alias("body"), "label", "source", "era_bucket", "augmented", "urls"), path)
    return readers.read_json(e.sparkSession, path, lines=True).select("id", _digest(F.col("body_text")).alias("body"), "label", "source", "era_bucket", "augmented", F.size("urls").cast("bigint").alias("urls"))


@register("json_array_scan", f"select md5({_BODY}) as body, lower(coalesce(sender_address, '')) as sender from emails")
def _(read):
    e = read("emails")
    path = workspace(e.sparkSession, "arrays")
    some = e.select(F.to_json(F.struct("subject", "body_text", F.col("sender_address").alias("from"), "label")).alias("value"))
    # one array a file: each Arrow batch is a file of its own
    arrays = some.mapInPandas(lambda bs: (pd.DataFrame({"value": ["[" + ",".join(b["value"]) + "]"]}) for b in bs if len(b)), "value string")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(e.sparkSession, path, "arr").select(_digest(F.col("body_text")).alias("body"), F.lower("sender_address").alias("sender"))


def _messages(e: DataFrame) -> DataFrame:
    """(path, content): each mail as a MIME message of a plain and an HTML part."""
    b64 = lambda c: F.base64(F.encode(T.text(c), "utf-8"))
    word = lambda c: F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(F.encode(c, "utf-8")), r"\s", ""), F.lit("?="))
    part = lambda kind, c: F.concat(F.lit(f"--q\r\nContent-Type: text/{kind}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(c), F.lit("\r\n"))
    head = F.concat(F.lit('From: "The Desk" <desk'), F.col("rec_id").cast("string"), F.lit("@mail.example>\r\nMessage-ID: "), T.text(F.try_element_at("headers", F.lit("Message-ID"))), F.lit("\r\nSubject: "), word(F.regexp_replace(T.text("subject"), r"[\r\n]+", " ")),
                    F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n"))
    file = F.when(F.size(F.coalesce("attachments", F.array().cast("array<struct<filename:string,mime_type:string>>"))) > 0, F.lit("--q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nxx\r\n")).otherwise("")
    raw = F.concat(head, part("plain", "body_text"), part("html", "body_html"), file, F.lit("--q--\r\n"))
    return e.select(F.concat(F.lit("mem/"), F.col("rec_id").cast("string")).alias("path"), F.encode(raw, "utf-8").alias("content"))


@register("mime_scan", f"select 'desk' || rec_id::varchar || '@mail.example' as sender, 'The Desk' as name, md5({_BODY}) as body, md5(coalesce(body_html, '')) as html, len(coalesce(attachments, [])) > 0 as has_file from emails")
def _(read):
    m = readers.parse_files(_messages(read("emails")))
    return m.select(F.col("sender_address").alias("sender"), F.col("sender_display_name").alias("name"), _digest(F.col("body_text")).alias("body"), _digest(F.col("body_html")).alias("html"), (F.size("attachments") > 0).alias("has_file"))


@register("forward_unwrap", "select rec_id, 'inner ' || rec_id::varchar as subject, 'in' || rec_id::varchar || '@mail.example' as sender_address, 'text ' || rec_id::varchar as body_text from emails")
def _(read):
    n = F.col("rec_id").cast("string")
    inner = F.concat(F.lit("see below\n\n---------- Forwarded message ----------\nFrom: Someone <in"), n, F.lit("@mail.example>\nSubject: inner "), n, F.lit("\n\ntext "), n)
    return readers.unwrap_forward(read("emails").select("rec_id", F.concat(F.lit("Fwd: "), T.text("subject")).alias("subject"), "sender_address", inner.alias("body_text"))).select("rec_id", "subject", "sender_address", "body_text")


@register("pasted_text", "select id, case id % 3 when 0 then 'json' when 1 then 'message' else 'body' end as kind, case id % 3 when 2 then '' else 's' || id::varchar end as subject, 'b' || id::varchar as body_text from triage_log")
def _(read):
    n = F.col("id").cast("string")
    text = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("s"), n).alias("subject"), F.concat(F.lit("b"), n).alias("body")))).when(F.col("id") % 3 == 1, F.concat(F.lit("From: a@x.example\nSubject: s"), n, F.lit("\n\nb"), n)).otherwise(F.concat(F.lit("b"), n))
    return readers.parse_pasted(read("triage_log").select("id", text.alias("t")), "t").select("id", "kind", "subject", "body_text")


@register("api_requests", rf"select id, coalesce(subject, '') as subject, len(regexp_extract_all({_BODY}, 'https?://[^\s<>""'']+'))::bigint as urls, 'Desk' as sender_display_name, 'd@mail.example' as sender_address, round(spam_prob, 6)::double as url_entropy from triage_log")
def _(read):
    r = readers.requests(read("triage_log").select("id", "subject", "body_text", F.lit('"Desk" <d@mail.example>').alias("from_addr"), F.col("spam_prob").alias("url_entropy")), L.FEATURE_VECTOR)
    return readers.overridden(r, ["url_entropy"]).select("id", "subject", F.size("urls").cast("bigint").alias("urls"), "sender_display_name", "sender_address", "url_entropy")


@register("suffix_loader", "select 'csv' as kind, count(*) as n from verdicts union all select 'jsonl', count(*) from verdicts union all select 'parquet', count(*) from verdicts")
def _(read):
    v = read("verdicts")
    path, out = workspace(v.sparkSession, "kinds"), None
    _csv(v.select("verdict_id", "email_id"), f"{path}/a.csv")
    writers.write_lines(v.select("verdict_id"), f"{path}/b.jsonl")
    v.write.parquet(f"{path}/c.parquet")
    for kind, name in (("csv", "a.csv"), ("jsonl", "b.jsonl"), ("parquet", "c.parquet")):
        one = readers.load(v.sparkSession, f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


@register("lookup_lines", f"select d as value from (select unnest([{_list(L.BRAND_DOMAINS)}]) as d)")
def _(read):
    spark = read("nation").sparkSession
    path = workspace(spark, "lookup")
    spark.createDataFrame([("# brands",), ("",), *[(f"  {b} ",) for b in L.BRAND_DOMAINS]], "value string").coalesce(1).write.text(path)
    return readers.lookup_lines(spark, path)


@register("catalogue_probe", "select 'here' as name, true as available, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test from emails union all select 'gone', false, 0, 0, 0")
def _(read):
    e = read("emails")
    path = workspace(e.sparkSession, "sets")
    for s in ("train", "val", "test"):
        writers.write_lines(e.where(F.col("split") == s).select("rec_id", "split"), f"{path}/{s}.jsonl")
    return readers.catalogue(e.sparkSession, {"here": path, "gone": f"{path}/gone"}).drop("path")


@register("json_profile", "select 'email_id' as path, 'string' as type, count(email_id) as n from triage_log union all select 'features', 'object', count(features) from triage_log union all select 'reasons', 'array', count(reasons) from triage_log union all select 'reasons[]', 'string', (select count(*) from (select unnest(reasons) from triage_log))")
def _(read):
    t = read("triage_log")
    path = workspace(t.sparkSession, "profile")
    writers.write_lines(t.select("email_id", "features", "reasons"), path)
    return readers.profile_json(t.sparkSession, path).where("not startswith(path, 'features.')")


@register("synthetic_mails", "select 'phishing' as label, 60::bigint as n, 60::bigint as ids, true as augmented union all select 'spam', 40, 40, true")
def _(read):
    return synthetic.generate(read("nation").sparkSession, {"phishing": 60, "spam": 40}).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.bool_and("augmented").alias("augmented"))


@register("concatenated", "select 'mail' as kind, rec_id as id, source from emails union all select 'report', id, null from triage_log")
def _(read):
    return readers.concatenated([read("emails").select(F.lit("mail").alias("kind"), F.col("rec_id").alias("id"), "source"), read("triage_log").select(F.lit("report").alias("kind"), "id")])


# ---- sinks -------------------------------------------------------------------------------------------------------
@register("split_files", "select coalesce(split, '') as split, count(*) as n from emails group by 1")
def _(read):
    e = read("emails")
    path = workspace(e.sparkSession, "splits")
    writers.write_splits(e.select("rec_id", F.when(F.col("split") == "", "none").otherwise(F.col("split")).alias("split")), path)
    back = e.sparkSession.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return back.select(F.when(F.col("split").isin("none", "__HIVE_DEFAULT_PARTITION__") | F.col("split").isNull(), "").otherwise(F.col("split")).alias("split"), "n")


@register("manifest", "select id, label, source, era_bucket, augmented, split from emails")
def _(read):
    return writers.manifest(read("emails"))


@register("tagged_json", "select verdict_id, email_id, strftime(reviewed_at, '%Y-%m-%dT%H:%M:%S.%f') as reviewed_at from verdicts")
def _(read):
    v = read("verdicts")
    path = workspace(v.sparkSession, "tagged")
    writers.write_tagged(v.select("verdict_id", "email_id", "reviewed_at"), path)
    back = v.sparkSession.read.schema("verdict_id bigint, email_id string, reviewed_at struct<__type__:string,value:string>").json(path)
    return back.select("verdict_id", "email_id", F.col("reviewed_at.value").alias("reviewed_at"))


_AUDIT = "email_id, received_at, model_version, subject, predicted_label, phishing_prob, spam_prob, trust_score, routed_to_review, analyst_label, analyst_id, reviewed_at, agreement, notes"


@register("audit_export", f"select email_id, epoch(received_at)::bigint as received_at, model_version, md5({_FLAT("coalesce(subject, '')")}) as subject, predicted_label, round(phishing_prob, 6)::double as phishing_prob, round(spam_prob, 6)::double as spam_prob, round(trust_score, 6)::double as trust_score, routed_to_review::bigint as routed_to_review, analyst_label, analyst_id, epoch(reviewed_at)::bigint as reviewed_at, agreement::bigint as agreement, notes from (select * from triage_log order by received_at desc nulls last, id desc limit 10000)")
def _(read):
    t = read("triage_log")
    path, rows = workspace(t.sparkSession, "audit"), writers.audit_export(t)
    rows.write.csv(path, header=True, quoteAll=True, escape='"', nullValue="\x00", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    back = t.sparkSession.read.schema(rows.schema).csv(path, header=True, multiLine=True, escape='"', nullValue="\x00", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return back.withColumns({"subject": _digest(_flat("subject")), "received_at": F.unix_seconds(F.col("received_at").cast("timestamp")), "reviewed_at": F.unix_seconds(F.col("reviewed_at").cast("timestamp"))})


@register("metrics_text", "select 'reports{label=\"' || predicted_label || '\"} ' || count(*)::varchar as value from triage_log where predicted_label is not null group by predicted_label")
def _(read):
    n = read("triage_log").where("predicted_label is not null").groupBy(F.col("predicted_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return writers.prometheus(n.select(F.lit("reports").alias("name"), "label", "n"))


@register("event_lines", "select 'data: {\"verdict_id\":' || verdict_id::varchar || ',\"analyst_label\":\"' || analyst_label || '\"}' || chr(10) as value from verdicts where analyst_label is not null")
def _(read):
    return writers.event_lines(read("verdicts").where("analyst_label is not null").select("verdict_id", "analyst_label"))


@register("safe_names", "select id, case when s = '' then 'msg_' || id::varchar else s end as name from (select id, trim(regexp_replace(substr(coalesce(subject, ''), 1, 30), '[^a-zA-Z0-9_-]', '_', 'g'), '_') as s from triage_log)")
def _(read):
    return read("triage_log").select("id", writers.safe_name(F.col("subject"), F.concat(F.lit("msg_"), F.col("id").cast("string"))).alias("name"))


@register("mailbox_urls", rf"select id, unnest(regexp_extract_all({_BODY}, 'https?://[^\s<>\x22\x27\x5c]+')) as url from triage_log")
def _(read):
    return read("triage_log").select("id", F.explode(T.mailbox_urls(F.col("body_text"))).alias("url"))


@register("model_texts", f"select rec_id, md5(coalesce(subject, '') || ' [SEP] ' || {_BODY}) as text from emails")
def _(read):
    return read("emails").select("rec_id", F.md5(T.model_text(F.col("subject"), F.col("body_text"))).alias("text"))


@register("model_columns", "select id, " + ", ".join(f"round(coalesce(features['{c}'], 0.0), 6)::double as {c}" for c in L.FEATURE_VECTOR) + " from triage_log")
def _(read):
    t = read("triage_log").select("id", *[F.try_element_at("features", F.lit(c)).alias(c) for c in L.FEATURE_VECTOR])
    return features.vector_columns(t)
