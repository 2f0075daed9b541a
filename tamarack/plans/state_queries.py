"""Queries of the state that persists, of audits and gates, and of fingerprints over plain words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, campaigns, evaluation, features, feedback, ledger
from ..storage import materialize, workspace
from .registry import _BODY, _queries, _root, register

def _sql(name: str) -> str:
    return f"({_queries[name][1]})"


# ---- the ledger --------------------------------------------------------------------------------------------------
@register("save_triage", """with r as (select *, nullif(campaign_cluster_id, '') as g from triage_log where email_id is not null),
 b as (select *, case when batch_no <= 10 then 1 else 2 end as b from r),
 f as (select email_id, arg_min(g, (received_at, id)) filter (where g is not null and b = 1) as f1, arg_min(g, (received_at, id)) filter (where g is not null and b = 2) as f2 from b group by 1),
 c1 as (select b.*, coalesce(g, f1, email_id) as c from b join f using (email_id) where b = 1), s1 as (select email_id, arg_max(c, (received_at, id)) as old from c1 group by 1),
 c2 as (select b.*, coalesce(g, old, f2, email_id) as c from b join f using (email_id) left join s1 using (email_id) where b = 2),
 a as (select email_id, id, received_at, predicted_label, model_version, c from c1 union all select email_id, id, received_at, predicted_label, model_version, c from c2)
select email_id, arg_max(id, (received_at, id)) as id, arg_max(coalesce(predicted_label, ''), (received_at, id)) as predicted_label, arg_max(c, (received_at, id)) as campaign_cluster_id, arg_min(coalesce(model_version, ''), (received_at, id)) as model_version from a group by 1""")
def _(read):
    t = read("triage_log")
    book = ledger.Ledger(t.sparkSession, workspace(t.sparkSession, "ledger"))
    for name, rows in (("1", t.where("batch_no <= 10")), ("2", t.where("batch_no > 10")), ("2", t)):  # the last is a repeated write
        book.save(name, rows, F.col("email_id"))
    return book.state().select("email_id", "id", F.coalesce("predicted_label", F.lit("")).alias("predicted_label"), "campaign_cluster_id", F.coalesce("model_version", F.lit("")).alias("model_version"))


@register("point_lookup", "select email_id, id from (select email_id, id, row_number() over (partition by email_id order by received_at desc, id desc) as rn from triage_log where email_id = (select min(email_id) from triage_log)) where rn = 1")
def _(read):
    t = read("triage_log")
    book = ledger.Ledger(t.sparkSession, workspace(t.sparkSession, "ledger"))
    book.save("1", t, F.col("email_id"))
    return book.find(t.agg(F.min("email_id")).first()[0] or "").select("email_id", "id")


def _signatures(t: DataFrame) -> DataFrame:
    """What judged reports teach: the first judged report of each campaign, hash and subject of plain words."""
    judged = t.where("coalesce(campaign_cluster_id, '') <> '' and analyst_label is not null and analyst_label <> 'Defer' and email_id is not null")
    first = judged.groupBy("campaign_cluster_id").agg(F.min_by(F.struct("id", "subject", "body_text", "sender_address", "analyst_label", "analyst_id", "notes", "received_at"), "id").alias("x")).select("campaign_cluster_id", "x.*")
    h = campaigns.simhash_of(first.select("id", _words("body_text").alias("words")))
    return first.join(h, "id").select(F.col("campaign_cluster_id").alias("cluster_id"), campaigns.hex16(F.col("simhash")).alias("simhash"), F.lower(F.trim(T.text("subject"))).alias("normalized_subject"), T.root_domain(F.col("sender_address")).alias("sender_domain"),
                                      F.col("analyst_label").alias("verdict"), "analyst_id", "notes", F.col("received_at").cast("string").alias("learned_at"), F.col("id").alias("seq"))


def _words(c: str):
    return F.regexp_extract_all(F.lower(T.text(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hash_sql(table: str, idc: str, text: str, out: str) -> str:
    """CTEs that end in `out` (id, h ubigint): 64-bit SimHash of plain words and word pairs."""
    return rf"""{out}_w as (select {idc} as id, regexp_extract_all(lower(coalesce({text}, '')), '[\pL\pN]+') as w from {table}),
 {out}_f as (select id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) else [] end)) as f from {out}_w),
 {out}_n as (select id, ('0x' || substr(md5(f), 1, 16))::ubigint as h, count(*) as n from {out}_f group by 1, 2),
 {out}_b as (select id, k, sum(case when (h >> k) & 1 = 1 then n else -n end) as v from {out}_n, (select unnest(range(64))::ubigint as k) group by 1, 2),
 {out} as (select w.id, coalesce(x.h, 0)::ubigint as h from {out}_w w left join (select id, sum(case when v > 0 then (1::hugeint << k::hugeint) else 0::hugeint end)::ubigint as h from {out}_b group by 1) x using (id))"""


_LEARNT = r"j as (select * from triage_log where coalesce(campaign_cluster_id, '') <> '' and analyst_label is not null and analyst_label <> 'Defer' and email_id is not null), e as (select campaign_cluster_id as cluster_id, arg_min(id, id) as id, arg_min(lower(trim(coalesce(subject, ''))), id) as s, arg_min(coalesce(sender_address, ''), id) as a, lower(trim(arg_min(analyst_label, id))) as verdict from j group by 1)"


@register("remember_verdicts", f"with {_LEARNT} select cluster_id, verdict, s as normalized_subject, {_root('a')} as sender_domain from e")
def _(read):
    t = read("triage_log")
    memory = ledger.Memory(t.sparkSession, workspace(t.sparkSession, "memory"))
    for _ in range(2):
        memory.remember("1", _signatures(t))
    return memory.entries().select("cluster_id", "verdict", "normalized_subject", "sender_domain")


@register("recall_by_memory", rf"""with {_LEARNT}, {_hash_sql('triage_log', 'id', 'body_text', 'hs')},
 m as (select t.id, case when t.id % 2 = 0 then coalesce(t.campaign_cluster_id, '') else '' end as c, lower(trim(coalesce(t.subject, ''))) as s, {_root('t.sender_address')} as d, hs.h from triage_log t join hs on hs.id = t.id),
 k as (select e.cluster_id, e.verdict, e.s, {_root('e.a')} as d, hs.h, e.id as seq from e join hs on hs.id = e.id),
 x as (select m.id, k.verdict as v from m join k on k.cluster_id = m.c), n as (select m.id, arg_min(k.verdict, k.seq) as v from m join k on m.d = k.d and m.s = k.s and bit_count(xor(m.h, k.h)) <= 5 where m.id not in (select id from x) group by 1)
select m.id, coalesce(x.v, n.v) as verdict, case when x.id is not null then 'cluster' when n.id is not null then 'near' end as matched_by from m left join x on x.id = m.id left join n on n.id = m.id""")
def _(read):
    t = read("triage_log")
    memory = ledger.Memory(t.sparkSession, workspace(t.sparkSession, "memory"))
    memory.remember("1", _signatures(t))
    h = campaigns.simhash_of(t.select("id", _words("body_text").alias("words")))
    mails = t.select("id", F.when(F.col("id") % 2 == 0, T.text("campaign_cluster_id")).otherwise("").alias("cluster_id"), F.lower(F.trim(T.text("subject"))).alias("subject_key"), T.root_domain(F.col("sender_address")).alias("sender_domain")).join(h, "id")
    return memory.lookup(mails).select("id", "verdict", "matched_by")


@register("memory_hits", f"with {_LEARNT} select e.cluster_id, e.verdict, count(t.id) as hit_count from e left join triage_log t on t.campaign_cluster_id = e.cluster_id group by 1, 2")
def _(read):
    t = read("triage_log")
    memory = ledger.Memory(t.sparkSession, workspace(t.sparkSession, "memory"))
    memory.remember("1", _signatures(t))
    memory.hit("1", t.select(F.col("campaign_cluster_id").alias("cluster_id")))
    out = memory.stats()
    gone = ledger.Memory(t.sparkSession, workspace(t.sparkSession, "memory"))
    gone.clear()
    return out


_STRIP = r"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(s, '\[.*?\]|\(.*?\)', '', 'g')), '[\s\-_|:]+(?:account|ref|reference|case|ticket|order|inv|invoice|id|batch|num|number)[\s#:]*[\pL\pN_\-]*\s*$', '')), '[\s\-_#:]+[a-f0-9\-]{3,}\s*$', ''))"


@register("cluster_subjects", rf"""with recursive a as (select id, trim(regexp_replace(trim(lower(coalesce(subject, ''))), '^(?:(?:re|fwd|fw|external|notice|urgent|action required|important)[\s\pZ:;\-\]]+)+', '')) as s from triage_log),
 r as (select id, s, {_STRIP} as t from a union all select id, t, {_STRIP.replace("regexp_replace(s,", "regexp_replace(t,")} from r where t <> s)
select id, case when z = '' then 'no_subject' else z end as subject_key from (select id, trim(regexp_replace(s, '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || '-_:|#') as z from r where s = t)""")
def _(read):
    return read("triage_log").select("id", T.cluster_subject(F.col("subject")).alias("subject_key"))


# ---- mailboxes ---------------------------------------------------------------------------------------------------
def _mails(read) -> DataFrame:
    return read("emails").select("rec_id", "subject", F.try_element_at("headers", F.lit("Message-ID")).alias("message_id"))


_MID = "lower(trim(trim(coalesce(headers['Message-ID'], ''), '<>')))"


@register("mailbox_feed", f"with m as (select rec_id, {_MID} as k, lower(regexp_extract(coalesce(subject, ''), '(?i)(REF-\\d+|wire-auth-\\d+|Ref\\s*#\\d+)', 1)) as r from emails) select max(rec_id) as rec_id from m where k <> '' and not starts_with(k, 'live-') group by k union all select max(rec_id) from m where (k = '' or starts_with(k, 'live-')) and r <> '' group by r union all select rec_id from m where (k = '' or starts_with(k, 'live-')) and r = ''")
def _(read):
    return ledger.feed(_mails(read), F.col("rec_id")).select("rec_id")


@register("mailbox_sync", f"with m as (select rec_id, augmented, {_MID} as k, lower(regexp_extract(coalesce(subject, ''), '(?i)(REF-\\d+|wire-auth-\\d+|Ref\\s*#\\d+)', 1)) as r from emails) select rec_id from m where k not in (select k from m where augmented and k <> '') and (r = '' or r not in (select r from m where augmented and r <> ''))")
def _(read):
    m = _mails(read)
    have = read("emails").where("augmented").select("subject", F.try_element_at("headers", F.lit("Message-ID")).alias("message_id"))
    return ledger.not_stored(m, have).select("rec_id")


@register("dedup_keys", f"select rec_id, {_MID} as message_key, lower(regexp_extract(coalesce(subject, ''), '(?i)(REF-\\d+|wire-auth-\\d+|Ref\\s*#\\d+)', 1)) as ref_key from emails")
def _(read):
    return _mails(read).select("rec_id", ledger.message_key(F.col("message_id")).alias("message_key"), ledger.ref_key(F.col("subject")).alias("ref_key"))


# ---- training sets and audits ------------------------------------------------------------------------------------
@register("retrain_set", """select 'train' as origin, label, 0.0::double as url_count from emails where split = 'train' and label in ('spam', 'phishing')
 union all select 'feedback', lower(analyst_label), round(coalesce(features['url_count'], 0.0), 6)::double from triage_log where analyst_label is not null and analyst_label <> 'Defer' and features is not null and cardinality(features) > 0 and lower(analyst_label) in ('spam', 'phishing')""")
def _(read):
    train = read("emails").where("split = 'train'").select(F.lit("train").alias("origin"), "label", F.lit(0.0).alias("url_count"))
    judged = feedback.labelled(read("triage_log")).withColumn("origin", F.lit("feedback"))
    return ledger.retrain_set(train, judged, columns=["url_count"])


@register("quality_gates", f"""with s as {_sql('sender_features')}, u as {_sql('url_features')}, t as (select * from emails where split = 'train'),
 a as (select count(*) filter (where label = 'spam') as a, count(*) filter (where label = 'phishing') as b, count(distinct case when label = 'phishing' then source end) as c, coalesce(avg(case when augmented then 1.0 else 0.0 end), 1.0) as d,
  coalesce(avg(case when url_count > 0 or shortened_url_present or suspicious_tld_present or display_from_mismatch or reply_to_mismatch or free_email_sender or length({_BODY}) > 0 then 1.0 else 0.0 end), 0.0) as e from t join s using (rec_id) join u using (rec_id)),
 g as (select 'spam_samples' as gate, a::double as value, 100.0::double as required, a >= 100 as passed from a union all select 'phishing_samples', b::double, 100.0, b >= 100 from a union all select 'phishing_source_diversity', c::double, 3.0, c >= 3 from a union all select 'synthetic_ratio', round(d, 6)::double, 0.25, d <= 0.25 from a union all select 'structural_coverage', round(e, 6)::double, 0.5, e > 0.5 from a)
select * from g union all select 'overall', sum(passed::int)::double, 5.0, bool_and(passed) from g""")
def _(read):
    train = features.features(read("emails").where("split = 'train'"), ("rec_id", "label", "source", "augmented"))
    return audit.gates(train, spam=100, phishing=100)


@register("good_rows", f"with b as {_sql('brand_features')} select rec_id, label from emails join b using (rec_id) where missing_feature_count <= 3 and label in ('spam', 'phishing')")
def _(read):
    return audit.good_rows(read("emails").withColumn("missing_feature_count", features.missing_count())).select("rec_id", "label")


@register("without_leaks", "select rec_id, label, coalesce(subject, '') as subject from emails")
def _(read):
    slim = audit.without_leaks(read("emails"))
    assert not set(audit.LEAKY) & set(slim.columns)
    return slim.select("rec_id", "label", T.text("subject").alias("subject"))


@register("without_sources", "with s as (select source from emails group by 1 order by count(*) desc, source limit 1) select rec_id, source from emails where source is null or source not in (select source from s)")
def _(read):
    e = read("emails")
    top = e.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    return audit.without_sources(e, [top["source"]] if top else [], passed=False).select("rec_id", "source")


def _contains(ps: list[str]) -> str:
    return " + ".join(f"contains(t, '{p}')::int" for p in ps)


@register("phrase_votes", f"with t as (select id, lower(coalesce(subject, '') || ' ' || {_BODY}) as t from triage_log), v as (select id, {_contains(audit.PHISHING_PHRASES)} as p, {_contains(audit.SPAM_PHRASES)} as s from t) select id, case when p > s then 'phishing' when s > p then 'spam' else '' end as vote from v")
def _(read):
    return read("triage_log").select("id", audit.phrase_vote("subject", "body_text").alias("vote"))


_S = "s as (select trust_score as score, (lower(analyst_label) = 'phishing')::int as y, phishing_prob as p from triage_log where analyst_label is not null and trust_score is not null and phishing_prob is not null)"


@register("auto_rate", f"with {_S}, a as (select count(*) as n, count(*) filter (where score > 75) as auto, count(*) filter (where score > 75 and y = 1) as pos, count(*) filter (where score > 75 and y = 1 and p >= 0.5) as hit from s) select n, auto, round(case when n > 0 then auto / n else 0.0 end, 6)::double as rate, round(case when pos > 0 then hit / pos else 0.0 end, 6)::double as recall from a")
def _(read):
    return evaluation.auto_rate(read("triage_log").where("analyst_label is not null and trust_score is not null and phishing_prob is not null").select(F.col("trust_score").alias("score"), (F.lower("analyst_label") == "phishing").cast("int").alias("y"), F.col("phishing_prob").alias("p")))


_RISKS = ["typosquatting_detected", "ip_literal_url", "reply_to_mismatch", "suspicious_tld_present", "sender_brand_mismatch"]


@register("override_count", f"select count(*) as n, count(*) filter (where phishing_prob > 0.7 and ({' or '.join(f'''coalesce(features['{r}'], 0) <> 0''' for r in _RISKS)})) as overridden from triage_log")
def _(read):
    return evaluation.override_count(read("triage_log").select(F.col("phishing_prob").alias("p"), *[F.try_element_at("features", F.lit(r)).alias(r) for r in _RISKS]), _RISKS)


@register("campaign_cards", """with c as (select coalesce(nullif(campaign_cluster_id, ''), email_id) as cluster_id, * from triage_log where routed_to_review = 1 and analyst_label is null),
 g as (select cluster_id, count(*) as reports, avg(case when coalesce(phishing_prob, 0) = 0 then 0.5 else phishing_prob end) as a, arg_max(case when coalesce(sender_address, '') <> '' then sender_address else 'unknown_sender' end, (received_at, id)) as sender, arg_max(coalesce(reasons[1], 'Boundary uncertainty'), (received_at, id)) as top_signal from c group by 1)
select cluster_id, reports, round(a, 6)::double as avg_phishing, sender, top_signal from g""")
def _(read):
    return campaigns.rollup(read("triage_log")).select("cluster_id", "reports", "avg_phishing", "sender", "top_signal")


@register("campaign_reports", "with c as (select coalesce(nullif(campaign_cluster_id, ''), email_id) as cluster_id, * from triage_log where routed_to_review = 1 and analyst_label is null), t as (select cluster_id, count(*) as n, min(case when coalesce(trust_score, 0) = 0 then 50.0 else trust_score end) as m from c group by 1 order by 2 desc, 3, 1 limit 50) select cluster_id, id, email_id from c join t using (cluster_id)")
def _(read):
    t = read("triage_log")
    return campaigns.reports_of(t, feedback.campaign_queue(t, 50)).select("cluster_id", "id", "email_id")


@register("filtered_count", "select count(*) as n from triage_log where (subject ilike '%invoice%' or body_text ilike '%invoice%' or sender_address ilike '%invoice%' or email_id ilike '%invoice%' or campaign_cluster_id ilike '%invoice%') and routed_to_review = 1")
def _(read):
    return feedback.search(read("triage_log"), "invoice", "", "review_needed").agg(F.count(F.lit(1)).alias("n"))


@register("review_rates", "select predicted_label as label, count(*) as n, round(avg(case when routed_to_review = 1 then 1.0 else 0.0 end), 6)::double as review_rate, round(avg(case when agreement = 0 then 1.0 else 0.0 end), 6)::double as override_rate from triage_log group by 1")
def _(read):
    share = lambda c: F.avg(F.expr(f"case when {c} then 1.0D else 0.0D end"))
    return read("triage_log").groupBy(F.col("predicted_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), share("routed_to_review = 1").alias("review_rate"), share("agreement = 0").alias("override_rate"))


# ---- fingerprints over plain words -------------------------------------------------------------------------------
@register("word_simhash", f"with {_hash_sql('emails', 'rec_id', 'body_text', 'hs')} select id as rec_id, lpad(lower(to_hex(h)), 16, '0') as simhash from hs")
def _(read):
    return campaigns.simhash_of(read("emails").select(F.col("rec_id").alias("id"), _words("body_text").alias("words"))).select(F.col("id").alias("rec_id"), campaigns.hex16(F.col("simhash")).alias("simhash"))


@register("word_campaign_ids", f"with {_hash_sql('emails', 'rec_id', 'body_text', 'hs')} select rec_id, 'camp_' || substr(sha256({_root('sender_address')} || '|' || lower(trim(coalesce(subject, ''))) || '|' || (h >> 20)::varchar), 1, 10) as campaign_id from emails join hs on hs.id = rec_id")
def _(read):
    e = read("emails")
    h = campaigns.simhash_of(e.select(F.col("rec_id").alias("id"), _words("body_text").alias("words")))
    keys = e.select(F.col("rec_id").alias("id"), T.root_domain(F.col("sender_address")).alias("d"), F.lower(F.trim(T.text("subject"))).alias("s"))
    return campaigns.campaign_key(keys.join(h, "id")).withColumnRenamed("id", "rec_id")


@register("word_hamming", f"with {_hash_sql('emails', 'rec_id', 'body_text', 'hs')}, r as (select h, min(id) as id from hs group by 1) select x.id as a, y.id as b, bit_count(xor(x.h, y.h))::bigint as distance from r x join r y on x.id < y.id and bit_count(xor(x.h, y.h)) <= 5")
def _(read):
    h = materialize(campaigns.simhash_of(read("emails").select(F.col("rec_id").alias("id"), _words("body_text").alias("words"))), "word-hash")
    return campaigns.near_pairs(campaigns.representatives(h))

