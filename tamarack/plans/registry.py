"""Every core query with the SQL that states it; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as X

from ..functions import lookups as L
from ..functions import text as T
from ..operators import audit, campaigns, dedup, evaluation, features, feedback, sampling
from ..storage import spread

Query = Callable[[Callable[[str], DataFrame]], DataFrame]
_queries: dict[str, tuple[Query, str | None]] = {}


def _list(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[name] = (f, sql)
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at six places, integers as bigint, so that engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, X.DoubleType | X.FloatType | X.DecimalType):
            c = F.round(c.cast("double"), places)
        elif isinstance(f.dataType, X.IntegerType | X.ShortType | X.ByteType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Query):
        return lambda spark, sf_dir: rounded(f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))

    return {n: bind(f) for n, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _queries.items() if s}


# ---- expressions shared by the SQL texts -------------------------------------------------------------------------
def _dom(c: str) -> str:
    a = f"lower(trim(coalesce({c}, '')))"
    return (f"(case when contains({a}, '@') and not contains({a}, '/') then list_extract(string_split({a}, '@'), -1) when regexp_extract({a}, 'https?://([^/?\\s]+)', 1) <> '' "
            f"then list_extract(string_split(regexp_extract({a}, 'https?://([^/?\\s]+)', 1), ':'), 1) else {a} end)")


_TOK = r"[^\s\pZ\x0b\x1c-\x1f\x{85}]+"
_HOST = r"lower(regexp_extract(u, '^https?://(?:[^@/?#]*@)?(\[[^\]]+\]|[^:/?#]*)', 1))"
_KEY = r"sha256(trim(regexp_replace(lower(coalesce(body_text, '')), '[\s\pZ\x0b\x1c-\x1f\x{85}]+', ' ', 'g')))"
_Y = "y as (select id, case when label = 'phishing' then 1 else 0 end y, p from (select id, lower(analyst_label) as label, phishing_prob as p from triage_log where analyst_label is not null and phishing_prob is not null) where label in ('phishing', 'spam'))"
_BODY = "coalesce(body_text, '')"


def _n(chars: str, c: str = _BODY) -> str:
    return f"length(regexp_replace({c}, '[^{chars}]', '', 'g'))"


def _scored(read) -> DataFrame:
    """(id, y, p): judged reports with a probability."""
    label = F.lower("analyst_label")
    return read("triage_log").where(label.isin("phishing", "spam") & F.col("phishing_prob").isNotNull()).select("id", (label == "phishing").cast("int").alias("y"), F.col("phishing_prob").alias("p"))


# ---- features ----------------------------------------------------------------------------------------------------
@register("text_features", rf"""
select rec_id, length(coalesce(subject, '')) as subject_length, length({_BODY}) as body_length,
 round(case when length({_BODY}) > 0 then {_n(r'\p{Lu}')} / length({_BODY}) else 0.0 end, 6)::double as uppercase_ratio,
 round(case when length({_BODY}) > 0 then {_n(r'\p{Nd}²³¹⁰⁴-⁹₀-₉')} / length({_BODY}) else 0.0 end, 6)::double as digit_ratio,
 round(case when length({_BODY}) > 0 then {_n(r'!-/:-@\[-`{-~')} / length({_BODY}) else 0.0 end, 6)::double as punctuation_density,
 round(case when len(regexp_extract_all({_BODY}, '{_TOK}')) > 0 then len(regexp_extract_all({_BODY}, 'https?://')) / len(regexp_extract_all({_BODY}, '{_TOK}')) else 0.0 end, 6)::double as link_density
from emails""")
def _(read):
    return spread(read("emails")).select("rec_id", *[c.alias(n) for n, c in features.text_features().items()])


@register("sender_features", rf"""
with s as (select rec_id, {_dom('sender_address')} as d, {_dom('reply_to')} as rd, coalesce(reply_to, '') as r,
  list_filter(regexp_extract_all(replace(lower(coalesce(sender_display_name, '')), '@', ' '), '{_TOK}'), lambda w: contains(w, '.') and length(w) > 4) as w from emails),
 t as (select *, case when len(w) > 0 then trim(w[1], '.,<>') else '' end as shown from s)
select rec_id, shown <> '' and shown <> d as display_from_mismatch, r <> '' and rd <> '' and rd <> d as reply_to_mismatch, d in ({_list(L.FREE_MAIL)}) as free_email_sender from t""")
def _(read):
    return spread(read("emails")).select("rec_id", *[c.alias(n) for n, c in features.sender_features().items()])


_brand_values = ", ".join(f"({i}, '{b}')" for i, b in enumerate(L.BRAND_DOMAINS))


@register("url_features", rf"""
with e as (select rec_id, coalesce(urls, []) as urls from emails),
 h as (select distinct rec_id, h from (select rec_id, {_HOST} as h from (select rec_id, unnest(urls) as u from e)) where h <> ''),
 f as (select rec_id, h, translate(lower(h), 'аеорсх', 'aeopcx') as n from h),
 g as (select rec_id, h, n, case when contains(n, '.') then array_to_string(list_slice(string_split(n, '.'), -2, -1), '.') else n end as reg, case when contains(h, '.') then string_split(h, '.')[1] else h end as lab from f),
 b(i, brand) as (values {_brand_values}),
 x as (select g.rec_id, g.h, min(case when g.reg = b.brand then b.i end) as same, min(case when g.reg <> b.brand and (levenshtein(g.reg, b.brand) <= 2 or starts_with(g.n, b.brand || '.')) then b.i end) as hit from g, b group by 1, 2),
 c as (select rec_id, h, lab, unnest(list_filter(string_split(lab, ''), lambda z: z <> '')) as ch from g),
 d as (select rec_id, h, ch, count(*) as k, any_value(length(lab)) as n from c group by 1, 2, 3),
 ent as (select rec_id, h, -sum(k / n * log2(k / n)) as e from d group by 1, 2),
 agg as (select h.rec_id, count(*) as domain_count, bool_or(h.h in ({_list(L.SHORTENERS)}) or {' or '.join(f"ends_with(h.h, '.{s}')" for s in L.SHORTENERS)}) as short,
   bool_or({' or '.join(f"ends_with(h.h, '{t}')" for t in L.SUSPICIOUS_TLDS)}) as tld, bool_or(regexp_full_match(h.h, '(\d{{1,3}}\.){{3}}\d{{1,3}}')) as ip,
   sum(coalesce(ent.e, 0)) / count(*) as entropy, bool_or(coalesce(x.hit < coalesce(x.same, 1000000), false)) as squat
  from h left join ent using (rec_id, h) left join x using (rec_id, h) group by 1)
select e.rec_id, len(e.urls) as url_count, coalesce(domain_count, 0) as domain_count, coalesce(short, false) as shortened_url_present, coalesce(tld, false) as suspicious_tld_present,
 coalesce(ip, false) as ip_literal_url, round(coalesce(entropy, 0.0), 6)::double as url_entropy, coalesce(squat, false) as typosquatting_detected from e left join agg using (rec_id)""")
def _(read):
    return spread(read("emails")).select("rec_id", *[c.alias(n) for n, c in features.url_features().items()])


@register("attachment_features", f"""
with a as (select rec_id, unnest(attachments) as a from emails),
 k as (select rec_id, case when contains(coalesce(a.filename, ''), '.') then '.' || lower(list_extract(string_split(a.filename, '.'), -1)) else '' end as ext, lower(coalesce(a.mime_type, '')) as m from a),
 t as (select rec_id, case when ext in ({_list(L.EXECUTABLE_EXT)}) or contains(m, 'executable') or contains(m, 'x-msdownload') then 'executable' when ext in ({_list(L.MACRO_EXT)}) or contains(m, 'macro') then 'macro'
  when ext in ({_list(L.ARCHIVE_EXT)}) or contains(m, 'zip') or contains(m, 'compressed') then 'archive' when contains(m, 'pdf') or ext = '.pdf' then 'pdf' when contains(m, 'office') or ext in ({_list(L.OFFICE_EXT)}) then 'office' else 'other' end as kind from k),
 g as (select rec_id, string_agg(distinct kind, ',' order by kind) as kinds, bool_or(kind = 'executable') as x, bool_or(kind = 'macro') as m from t group by 1)
select rec_id, kinds is not null as has_attachment, coalesce(kinds, '') as attachment_type, coalesce(x, false) as executable_detected, coalesce(m, false) as macro_detected from emails left join g using (rec_id)""")
def _(read):
    return spread(read("emails")).select("rec_id", *[c.alias(n) for n, c in features.attachment_features().items()])


_first_brand = "case " + " ".join(f"when contains(b, '{x.split('.')[0]}') or contains(d, '{x}') then '{x}'" for x in L.BRAND_DOMAINS) + " end"


@register("brand_features", f"""
with e as (select rec_id, lower(coalesce(subject, '') || ' ' || {_BODY}) as b, {_dom('sender_address')} as d, sender_address, body_text from emails), x as (select *, {_first_brand} as brand from e)
select rec_id, brand is not null as brand_mention, coalesce(not contains(d, brand) and not contains(brand, d), false) as sender_brand_mismatch,
 (case when coalesce(sender_address, '') = '' then 3 else 0 end + case when coalesce(body_text, '') = '' then 4 else 0 end)::bigint as missing_feature_count from x""")
def _(read):
    return spread(read("emails")).select("rec_id", *[c.alias(n) for n, c in features.brand_features().items()], features.missing_count().alias("missing_feature_count"))


def _parts() -> str:
    """The feature rows as one table, from the SQL of their parts."""
    names = ("sender_features", "url_features", "attachment_features", "text_features", "brand_features")
    return "select * from " + " join ".join(f"({_queries[n][1]}) as q{i}" + (" using (rec_id)" if i else "") for i, n in enumerate(names))


@register("all_features", _parts())
def _(read):
    return features.features(read("emails"))


@register("mail_ids", f"select rec_id, sha256(coalesce(subject, '') || substr({_BODY}, 1, 500)) as mail_id, sha256(coalesce(subject, '') || ' [SEP] ' || {_BODY}) as model_text_hash from emails")
def _(read):
    return read("emails").select("rec_id", T.mail_id(F.col("subject"), F.col("body_text")).alias("mail_id"), F.sha2(T.model_text(F.col("subject"), F.col("body_text")), 256).alias("model_text_hash"))


@register("body_urls", rf"select rec_id, unnest(regexp_extract_all({_BODY}, 'https?://[^\s<>""'']+')) as url from emails")
def _(read):
    return read("emails").select("rec_id", F.explode(T.urls_of(F.col("body_text"))).alias("url"))


@register("host_list", f"select distinct h as host from (select {_HOST} as h from (select unnest(urls) as u from emails)) where h <> ''")
def _(read):
    return read("emails").select(F.explode("urls").alias("u")).select(T.host(F.col("u")).alias("host")).where("host <> ''").distinct()


@register("label_counts", f"select case when l in ({_list(L.SPAM_LABELS)}) then 'spam' when l in ({_list(L.PHISHING_LABELS)}) then 'phishing' else '' end as label, count(*) as n from (select lower(trim(coalesce(analyst_label, ''))) as l from triage_log) group by 1")
def _(read):
    return read("triage_log").groupBy(T.label_of(F.col("analyst_label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("era_counts", f"with y as (select nullif(regexp_extract({_BODY}, '(?:19|20)[0-9][0-9]'), '')::int as y from emails) select case when y is null then 'unknown' when y < 2010 then 'legacy' when y < 2018 then 'mid' else 'recent' end as era, count(*) as n from y group by 1")
def _(read):
    """The era of the first year that a body names."""
    year = F.nullif(F.regexp_extract(T.text("body_text"), "(?:19|20)[0-9][0-9]", 0), F.lit("")).cast("int")
    return read("emails").groupBy(T.era_of(year).alias("era")).agg(F.count(F.lit(1)).alias("n"))


@register("snippets", rf"with t as (select rec_id, array_to_string(list_slice(regexp_extract_all({_BODY}, '{_TOK}'), 1, 22), ' ') as s from emails) select rec_id, case when length(s) > 140 then substr(s, 1, 140) || '...' else s end as snippet from t")
def _(read):
    return read("emails").select("rec_id", T.snippet(F.col("body_text")).alias("snippet"))


@register("html_text", r"with t as (select rec_id, trim(regexp_replace(coalesce(body_html, ''), '<[^>]+>', ' ', 'g')) as b, coalesce(body_html, '') as h from emails) select rec_id, case when b <> '' then b else h end as plain from t")
def _(read):
    return read("emails").select("rec_id", T.html_text(F.col("body_html")).alias("plain"))


# ---- deduplication, sampling, audits -----------------------------------------------------------------------------
_RANK = "case " + " ".join(f"when contains(lower(coalesce(source, '')), '{s}') then {i}" for i, s in enumerate(L.SOURCE_QUALITY)) + f" else {len(L.SOURCE_QUALITY)} end"


@register("exact_dedup", f"select rec_id, id, ({_RANK})::bigint as source_rank from emails qualify row_number() over (partition by id order by {_RANK}, rec_id) = 1")
def _(read):
    return dedup.exact(read("emails"), "id", "rec_id", "source").select("rec_id", "id", "source_rank")


@register("first_by_body", f"select min(rec_id) as rec_id from emails group by {_KEY}")
def _(read):
    return dedup.first_by_body(read("emails"), "rec_id", "body_text").select("rec_id")


def _mail_text() -> Column:
    return F.concat(T.text("subject"), F.lit(" "), T.text("body_text"))


@register("near_character_pairs", r"""
with t as (select rec_id, regexp_replace(lower(coalesce(subject, '') || ' ' || coalesce(body_text, '')), '[\s\pZ\x0b\x1c-\x1f\x{85}]+', ' ', 'g') as t from emails),
 g as (select rec_id, list_sort(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i::int, 3)))) as g from t where length(t) >= 3),
 c as (select min(rec_id) as id, g from g group by g), u as (select id, unnest(g) as x, len(g) as n from c),
 p as (select a.id as a, b.id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from u a join u b on a.x = b.x and a.id < b.id and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) group by 1, 2)
select a, b from p where k >= 0.85 * (na + nb - k) union all select c.id, g.rec_id from g join c using (g) where g.rec_id <> c.id""")
def _(read):
    return dedup.near_duplicate_pairs(read("emails"), "rec_id", _mail_text())


@register("greedy_near_dedup")
def _(read):
    return dedup.greedy(read("emails"), "rec_id", _mail_text(), T.source_rank(F.col("source"))).select(F.col("id").alias("rec_id"))


@register("split_overlap", f"""
with k as (select {_KEY} as k, bool_or(split = 'train') as t, bool_or(split = 'val') as v, bool_or(split = 'test') as e from emails where split in ('train', 'val', 'test') group by 1)
select 'train' as left_split, 'val' as right_split, count(*) filter (where t and v) as bodies from k union all select 'train', 'test', count(*) filter (where t and e) from k union all select 'val', 'test', count(*) filter (where v and e) from k""")
def _(read):
    return audit.split_overlap(read("emails"))


@register("capped_by_label", "select rec_id, label from emails qualify row_number() over (partition by label order by rec_id) <= 200")
def _(read):
    return sampling.capped(read("emails").select("rec_id", "label"), "label", "rec_id", 200)


@register("random_sample", "select rec_id from emails order by md5('42|' || rec_id::varchar), rec_id limit 150")
def _(read):
    return sampling.random_rows(read("emails"), "rec_id", 150).select("rec_id")


@register("temporal_split", """
with o as (select rec_id, label, augmented, row_number() over (partition by label, augmented order by case when augmented then 0 when era_bucket = 'legacy' then 0 when era_bucket = 'recent' then 2 else 1 end, case when augmented then md5('42|' || rec_id::varchar) else '' end, rec_id) as rn,
 count(*) over (partition by label, augmented) as n from emails where label in ('spam', 'phishing') and coalesce(body_text, '') <> '')
select rec_id, case when rn <= floor(n * 0.7) then 'train' when rn <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from o""")
def _(read):
    good = read("emails").where("label in ('spam', 'phishing') and coalesce(body_text, '') <> ''").drop("split")
    return sampling.temporal_split(good).select("rec_id", "split")


@register("stratified_split", """
with g as (select label, source from emails where not augmented group by 1, 2 having count(*) >= 3),
 o as (select rec_id, row_number() over (partition by label, source order by md5('42|' || rec_id::varchar), rec_id) as rn, count(*) over (partition by label, source) as n from emails join g using (label, source) where not augmented)
select rec_id, case when rn <= floor(n * 0.7) then 'train' when rn <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from o union all select rec_id, 'train' from emails where augmented""")
def _(read):
    return sampling.stratified_split(read("emails").drop("split")).select("rec_id", "split")


@register("budgeted_sample")
def _(read):
    good = read("emails").where("label in ('spam', 'phishing') and coalesce(body_text, '') <> ''")
    return sampling.budgeted(good, 150, 200, {"legacy": 0.35, "mid": 0.45, "recent": 0.6}).select("rec_id", "label", "source", "era_bucket", "augmented")


@register("coverage_counts", """select count(*) filter (where label = 'spam') as spam, count(*) filter (where label = 'phishing') as phishing, count(distinct source) as sources, round(avg(case when augmented then 1.0 else 0.0 end), 6)::double as augmented_share,
 round(avg(case when coalesce(sender_address, '') <> '' and coalesce(body_text, '') <> '' then 1.0 else 0.0 end), 6)::double as covered_share from emails""")
def _(read):
    return audit.coverage(read("emails"))


_NULLABLE = ["model_version", "subject", "body_text", "predicted_label", "analyst_label", "analyst_id", "notes", "campaign_cluster_id", "sender_address"]


@register("null_report", " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls, count(*) filter (where {c} = '') as blanks from triage_log" for c in _NULLABLE))
def _(read):
    return audit.null_report(read("triage_log"), _NULLABLE)


_NUMERIC = ["spam_prob", "phishing_prob", "trust_score"]


@register("numeric_stats", " union all ".join(
    f"select '{c}' as column_name, count({c}) as n, round(avg({c}), 6)::double as mean, round(stddev_samp({c}), 6)::double as sd, round(min({c}), 6)::double as least, " + ", ".join(f"round(quantile_cont({c}, {p}), 4)::double as p{int(p * 100)}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + f", round(max({c}), 6)::double as most from triage_log" for c in _NUMERIC))
def _(read):
    d = audit.describe(read("triage_log"), _NUMERIC)
    return d.withColumns({c: F.round(c, 4) for c in d.columns if c[0] == "p" and c[1:].isdigit()})  # interpolated points of six-place values fall between places


_CATEGORICAL = ["label", "source", "era_bucket", "subtype", "split"]


@register("value_counts", " union all ".join(f"select '{c}' as column_name, {c} as value, count(*) as n from emails group by {c}" for c in _CATEGORICAL))
def _(read):
    return audit.value_counts(read("emails"), _CATEGORICAL)


@register("distinct_counts", "select " + ", ".join(f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as {c}" for c in _CATEGORICAL) + " from emails")
def _(read):
    return read("emails").agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("bigint"))).alias(c) for c in _CATEGORICAL])


_FLAGS = ["has_attachment", "executable_detected", "macro_detected"]
_ATT_SQL = """with a as (select e.rec_id, e.label, e.split, len(coalesce(e.attachments, [])) > 0 as has_attachment, coalesce(e.reply_to, '') <> '' as has_reply, len(coalesce(e.urls, [])) > 0 as has_url from emails e)"""


@register("boolean_rates", _ATT_SQL + " " + " union all ".join(f"select '{c}' as column_name, round(avg(case when {c} then 1.0 else 0.0 end), 6)::double as rate from a" for c in ("has_attachment", "has_reply", "has_url")))
def _(read):
    return audit.boolean_rates(_flags(read), ["has_attachment", "has_reply", "has_url"])


@register("label_signal", _ATT_SQL + " " + " union all ".join(f"select label, '{c}' as column_name, round(avg(case when {c} then 1.0 else 0.0 end), 6)::double as rate from a group by label" for c in ("has_attachment", "has_reply", "has_url")))
def _(read):
    return audit.boolean_rates(_flags(read), ["has_attachment", "has_reply", "has_url"], "label")


def _flags(read) -> DataFrame:
    none = F.array()
    return read("emails").select("label", (F.size(F.coalesce("attachments", none.cast("array<struct<filename:string,mime_type:string>>"))) > 0).alias("has_attachment"), (T.text("reply_to") != "").alias("has_reply"), (F.size(F.coalesce("urls", none.cast("array<string>"))) > 0).alias("has_url"))


@register("split_drift", " union all ".join(f"select '{n}' as column_name, split, round(avg({e}), 6)::double as mean, round(quantile_cont({e}, 0.5), 6)::double as median from emails group by split" for n, e in (("url_count", "len(coalesce(urls, []))"), ("body_length", f"length({_BODY})"))))
def _(read):
    e = read("emails").select("split", F.size(F.coalesce("urls", F.array().cast("array<string>"))).cast("bigint").alias("url_count"), F.length(T.text("body_text")).cast("bigint").alias("body_length"))
    return audit.numeric_drift(e, ["url_count", "body_length"])


_BAD = {"attachment_inconsistency": "not has_attachment and attachment_type <> ''", "body_length_mismatch": f"length({_BODY}) <> body_length", "subject_length_mismatch": "length(coalesce(subject, '')) <> subject_length",
        "digit_ratio_out_of_bounds": "digit_ratio < 0 or digit_ratio > 1", "uppercase_ratio_out_of_bounds": "uppercase_ratio < 0 or uppercase_ratio > 1", "link_density_out_of_bounds": "link_density < 0 or link_density > 1"}


@register("consistency_checks", f"with f as ({_parts()}), a as (select f.*, e.subject, e.body_text from f join emails e using (rec_id)) " + " union all ".join(f"select '{n}' as check_name, count(*) filter (where {c}) as bad from a" for n, c in _BAD.items()))
def _(read):
    e = read("emails")
    return audit.consistency(features.features(e, ("rec_id", "subject", "body_text")))


def _hits(phrases: list[str]) -> str:
    return " + ".join(f"contains(t, '{p}')::int" for p in phrases)


@register("keyword_kappa", f"""
with k as (select lower(analyst_label) as a, case when phish > spam then 'phishing' when spam > phish then 'spam' else null end as b from (select analyst_label, {_hits(audit.PHISHING_PHRASES)} as phish, {_hits(audit.SPAM_PHRASES)} as spam
 from (select analyst_label, lower(coalesce(subject, '') || ' ' || coalesce(body_text, '')) as t from triage_log))),
 p as (select a, b, count(*) as n from k where a is not null and b is not null group by 1, 2), t as (select sum(n)::double as n, sum(case when a = b then n else 0 end)::double as same from p),
 e as (select coalesce(sum(x.n::double * y.n::double), 0) as e from (select a as k, sum(n) as n from p group by 1) x join (select b as k, sum(n) as n from p group by 1) y using (k))
select n::bigint as n, round(same / n, 6)::double as agreement, round(case when e / (n * n) = 1 then same / n else (same / n - e / (n * n)) / (1 - e / (n * n)) end, 6)::double as kappa from t, e""")
def _(read):
    vote = F.nullif(audit.phrase_vote("subject", "body_text"), F.lit(""))
    return evaluation.kappa(read("triage_log").select(F.lower("analyst_label").alias("a"), vote.alias("b")), "a", "b")


# ---- evaluation --------------------------------------------------------------------------------------------------
@register("confusion", f"""with {_Y}, c as (select count(*) filter (where p >= 0.5 and y = 1) as tp, count(*) filter (where p >= 0.5 and y = 0) as fp, count(*) filter (where p < 0.5 and y = 0) as tn, count(*) filter (where p < 0.5 and y = 1) as fn from y)
select tp, fp, tn, fn, round((tp + tn) / (tp + tn + fp + fn), 6)::double as accuracy, round(tp / (tp + fp), 6)::double as precision, round(tp / (tp + fn), 6)::double as recall, round(2 * tp / (2 * tp + fp + fn), 6)::double as f1 from c""")
def _(read):
    return evaluation.confusion(_scored(read))


@register("auc", f"""with {_Y}, s as (select p, sum(y) as pos, sum(1 - y) as neg from y group by 1),
 r as (select pos, neg, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over (order by p desc rows unbounded preceding) as tp, sum(neg) over (order by p desc rows unbounded preceding) as fp from s)
select round((sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)))::double, 6) as roc_auc, round((sum(pos * tp / (tp + fp)) / sum(pos))::double, 6) as average_precision from r""")
def _(read):
    return evaluation.auc(_scored(read))


@register("brier_logloss", f"with {_Y}, q as (select y, p, greatest(1e-7, least(1 - 1e-7, p)) as q from y) select round(avg((p - y) * (p - y)), 6)::double as brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6)::double as log_loss from q")
def _(read):
    return evaluation.brier_logloss(_scored(read))


_BIN = "case " + " ".join(f"when p >= {a!r} and p < {b!r} then {k}" for k, (a, b) in enumerate(zip(evaluation.EDGES, evaluation.EDGES[1:]))) + " end"


@register("ece_decision", f"with {_Y}, b as (select {_BIN} as bin, case when y = case when p >= 0.5 then 1 else 0 end then 1.0 else 0.0 end as ok, p from y), g as (select bin, count(*) as n, avg(ok) as acc, avg(p) as conf from b where bin is not null group by 1) select round(sum(n * abs(acc - conf)) / (select count(*) from y), 6)::double as ece from g")
def _(read):
    return evaluation.ece_decision(_scored(read))


@register("ece_toplabel", f"with {_Y}, b as (select least(floor(c * 10), 9) as bin, ok, c from (select greatest(p, 1 - p) as c, case when y = case when p >= 0.5 then 1 else 0 end then 1.0 else 0.0 end as ok from y)), g as (select bin, count(*) as n, avg(ok) as acc, avg(c) as conf from b group by 1) select round(sum(n * abs(acc - conf)) / sum(n), 6)::double as ece from g")
def _(read):
    return evaluation.ece_toplabel(_scored(read))


@register("calibration_curve", f"with {_Y} select coalesce({_BIN}, 9)::bigint as bin, count(*) as n, round(avg(p), 6)::double as mean_p, round(avg(y), 6)::double as rate from y group by 1")
def _(read):
    return evaluation.calibration_curve(_scored(read))


@register("threshold_sweep", f"""with {_Y}, t as (select k / 20.0::double as threshold from (select unnest(range(1, 20)) as k))
select round(threshold, 6)::double as threshold, count(*) filter (where p >= threshold and y = 1) as tp, count(*) filter (where p >= threshold and y = 0) as fp, count(*) filter (where p < threshold and y = 0) as tn, count(*) filter (where p < threshold and y = 1) as fn from y, t group by 1""")
def _(read):
    return evaluation.threshold_sweep(_scored(read))


@register("trust_bands", """with s as (select trust_score as score, case when lower(analyst_label) = 'phishing' then 1 else 0 end as y, case when predicted_label = 'phishing' then 1 else 0 end as hit from triage_log where analyst_label is not null and trust_score is not null)
select (case when score > 90 then 0 when score > 75 then 1 when score > 55 then 2 else 3 end)::bigint as band, count(*) as n, sum(y)::bigint as positives, count(*) filter (where y = 1 and hit = 0) as missed from s group by 1""")
def _(read):
    s = read("triage_log").where("analyst_label is not null and trust_score is not null").select(F.col("trust_score").alias("score"), (F.lower("analyst_label") == "phishing").cast("int").alias("y"), (F.coalesce("predicted_label", F.lit("")) == "phishing").cast("int").alias("hit"))
    return evaluation.score_bands(s)


# ---- the ledger --------------------------------------------------------------------------------------------------
@register("dashboard", """with c as (select count(*) as total, count(*) filter (where predicted_label = 'phishing') as phishing, count(*) filter (where predicted_label = 'spam') as spam, count(*) filter (where routed_to_review = 1) as routed, count(*) filter (where routed_to_review = 1 and analyst_label is null) as pending,
 count(*) filter (where analyst_label is not null) as reviewed, count(*) filter (where agreement = 1) as agreed, count(*) filter (where agreement = 0) as overridden, count(*) filter (where analyst_label = 'Defer') as deferred, count(*) filter (where predicted_label = 'legitimate_benign' or analyst_label in ('benign', 'legitimate')) as benign from triage_log)
select *, round(case when agreed + overridden > 0 then agreed / (agreed + overridden) else 1.0 end * 100, 1)::double as agreement_rate, round(case when agreed + overridden > 0 then overridden / (agreed + overridden) else 0.0 end * 100, 1)::double as override_rate from c""")
def _(read):
    return feedback.dashboard(read("triage_log"))


@register("workload", """with c as (select count(*) as total, count(*) filter (where routed_to_review = 1 and analyst_label is null) as pending, count(*) filter (where routed_to_review = 0) as auto,
 count(distinct case when routed_to_review = 1 and analyst_label is null then coalesce(nullif(campaign_cluster_id, ''), email_id) end) as campaigns from triage_log)
select total, pending, campaigns, auto, round(case when pending > 0 then pending / greatest(campaigns, 1) else 1.0 end, 1)::double as compression, round(case when pending > 1 then (1 - campaigns / pending) * 100 else 0.0 end, 1)::double as effort_saved, round(case when total > 0 then auto / total * 100 else 0.0 end, 1)::double as deflection from c""")
def _(read):
    return feedback.workload(read("triage_log"))


@register("campaign_rollup", """select coalesce(nullif(campaign_cluster_id, ''), email_id) as cluster_id, count(*) as reports, round(avg(case when coalesce(phishing_prob, 0) = 0 then 0.5 else phishing_prob end), 6)::double as avg_phishing, round(min(case when coalesce(trust_score, 0) = 0 then 50.0 else trust_score end), 6)::double as min_trust,
 floor(epoch(min(received_at)))::bigint as first_seen, floor(epoch(max(received_at)))::bigint as last_seen, arg_max(coalesce(subject, '(no subject)'), (received_at, id)) as subject from triage_log where routed_to_review = 1 and analyst_label is null group by 1""")
def _(read):
    return campaigns.rollup(read("triage_log")).drop("sender", "top_signal").withColumns({c: F.unix_seconds(c) for c in ("first_seen", "last_seen")})


@register("campaign_queue", """with c as (select coalesce(nullif(campaign_cluster_id, ''), email_id) as cluster_id, count(*) as reports, min(case when coalesce(trust_score, 0) = 0 then 50.0 else trust_score end) as min_trust from triage_log where routed_to_review = 1 and analyst_label is null group by 1)
select cluster_id, reports, round(min_trust, 6)::double as min_trust from c order by reports desc, c.min_trust, cluster_id limit 50""")
def _(read):
    return feedback.campaign_queue(read("triage_log"), 50).select("cluster_id", "reports", "min_trust")


@register("review_queue", "select id, email_id, round(trust_score, 6)::double as trust_score from (select * from triage_log where routed_to_review = 1 and analyst_label is null order by trust_score asc nulls first, id limit 50 offset 50)")
def _(read):
    return feedback.queue(read("triage_log"), 50, 50).select("id", "email_id", "trust_score")


@register("latest_state", "select email_id, arg_max(id, (received_at, id)) as id, count(*) as deliveries from triage_log where email_id is not null group by 1")
def _(read):
    log = read("triage_log")
    return campaigns.latest(log).select("email_id", "id").join(log.groupBy("email_id").agg(F.count(F.lit(1)).alias("deliveries")), "email_id")


@register("verdict_overlay", """with v as (select email_id, arg_max(analyst_label, (reviewed_at, verdict_id)) as l, arg_max(analyst_id, (reviewed_at, verdict_id)) as a from verdicts group by 1)
select id, coalesce(v.l, t.analyst_label) as analyst_label, case when v.email_id is not null then v.a else t.analyst_id end as analyst_id, (case when v.email_id is not null then case when lower(v.l) = lower(predicted_label) then 1 when lower(v.l) <> lower(predicted_label) then 0 end else agreement end)::bigint as agreement from triage_log t left join v using (email_id)""")
def _(read):
    return feedback.with_verdicts(read("triage_log"), read("verdicts")).select("id", "analyst_label", "analyst_id", "agreement")


@register("bulk_verdict", """with c as (select campaign_cluster_id as c from triage_log where coalesce(campaign_cluster_id, '') <> '' and analyst_label is null group by 1 order by count(*) desc, 1 limit 1)
select id, case when t.campaign_cluster_id = c.c and analyst_label is null then 'phishing' else analyst_label end as analyst_label, (case when t.campaign_cluster_id = c.c and analyst_label is null then case when lower(predicted_label) = 'phishing' then 1 when predicted_label is not null then 0 end else agreement end)::bigint as agreement from triage_log t, c""")
def _(read):
    log = read("triage_log")
    top = log.where("coalesce(campaign_cluster_id, '') <> '' and analyst_label is null").groupBy("campaign_cluster_id").count().orderBy(F.desc("count"), "campaign_cluster_id").first()
    return feedback.bulk_verdict(log, top[0] if top else "", "phishing", "bulk", F.lit("2026-01-01").cast("timestamp")).select("id", "analyst_label", "agreement")


@register("labelled_export", "select id, lower(analyst_label) as label from triage_log where analyst_label is not null and analyst_label <> 'Defer'")
def _(read):
    return read("triage_log").where("analyst_label is not null and analyst_label <> 'Defer'").select("id", F.lower("analyst_label").alias("label"))


@register("audit_search", "select id from triage_log where (subject ilike '%invoice%' or body_text ilike '%invoice%' or sender_address ilike '%invoice%' or email_id ilike '%invoice%' or campaign_cluster_id ilike '%invoice%') and predicted_label = 'phishing' and agreement = 0")
def _(read):
    return feedback.search(read("triage_log"), "invoice", "phishing", "overridden").select("id")


@register("audit_log", "select id, email_id, predicted_label, analyst_label from (select * from triage_log order by id desc limit 10000)")
def _(read):
    return feedback.page(read("triage_log"), [F.desc("id")], 10_000).select("id", "email_id", "predicted_label", "analyst_label")


_W7 = "w as (select * from triage_log where analyst_label is not null and analyst_label <> 'Defer' and reviewed_at >= (select max(reviewed_at) from triage_log) - interval 7 day)"


@register("override_rate", f"with {_W7} select count(*) as reviewed, count(*) filter (where agreement = 0) as overrides, count(*) filter (where agreement = 1) as agreements, round(case when count(*) > 0 then count(*) filter (where agreement = 0) / count(*) else 0.0 end, 6)::double as rate from w")
def _(read):
    return feedback.override_rate(read("triage_log"))


@register("traffic_mix", """with w as (select * from triage_log where received_at >= (select max(received_at) from triage_log) - interval 7 day)
select count(*) as reports, round(avg(case when predicted_label = 'phishing' then 1.0 else 0.0 end) * 100, 1)::double as phishing_pct, round(avg(case when predicted_label = 'spam' then 1.0 else 0.0 end) * 100, 1)::double as spam_pct, round(avg(case when routed_to_review = 1 then 1.0 else 0.0 end) * 100, 1)::double as review_pct, round(avg(trust_score), 1)::double as avg_trust from w""")
def _(read):
    return feedback.traffic(read("triage_log"))


@register("cache_hits", "select c.cluster_id, count(t.id) as hits from fast_path_cache c left join triage_log t on t.campaign_cluster_id = c.cluster_id group by 1")
def _(read):
    return feedback.hits(read("triage_log"), read("fast_path_cache"))


@register("cache_stats", "select count(*) as signatures, sum(hit_count)::bigint as hits from fast_path_cache")
def _(read):
    return read("fast_path_cache").agg(F.count(F.lit(1)).alias("signatures"), F.sum("hit_count").cast("bigint").alias("hits"))


@register("score_quantiles", "with s as (select phishing_prob as v, row_number() over (order by phishing_prob) as rn, count(*) over () as n from triage_log where phishing_prob is not null) select point, round(v, 6)::double as value from s, (values (0.5::double), (0.99::double)) q(point) where rn = floor(n * point) + 1")
def _(read):
    return feedback.ranked_quantiles(read("triage_log"), "phishing_prob")


@register("feature_usage", "select key, count(*) as n, round(avg(value), 6)::double as mean from (select unnest(map_keys(features)) as key, unnest(map_values(features)) as value from triage_log where features is not null) group by 1")
def _(read):
    return read("triage_log").where("features is not null").select(F.explode("features")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@register("reason_counts", "select reason, count(*) as n from (select unnest(reasons) as reason from triage_log) group by 1")
def _(read):
    return read("triage_log").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("event_windows", "select window_start, count(*) as n from (select unnest(generate_series(date_trunc('day', ts) - interval 6 day, date_trunc('day', ts), interval 1 day)) as window_start from events) group by 1")
def _(read):
    w = F.window(F.col("ts").cast("timestamp"), "7 days", "1 day")
    return read("events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


# ---- campaigns ---------------------------------------------------------------------------------------------------
def _root(c: str) -> str:
    a = f"coalesce({c}, '')"
    d = rf"lower(case when regexp_extract({a}, '[\w.-]+@([\w.-]+\.[a-zA-Z]{{2,}})', 1) <> '' then regexp_extract({a}, '[\w.-]+@([\w.-]+\.[a-zA-Z]{{2,}})', 1) else trim(list_extract(string_split({a}, '@'), -1), '<>""'' ') end)"
    p = f"string_split({d}, '.')"
    return (f"case when not contains({a}, '@') then 'unknown_domain' when len({p}) >= 3 and list_extract({p}, -2) in ({_list(L.SECOND_LEVEL)}) then array_to_string(list_slice({p}, -3, -1), '.') when len({p}) >= 2 then array_to_string(list_slice({p}, -2, -1), '.') else {d} end")


@register("root_domains", f"select id, {_root('sender_address')} as root_domain from triage_log")
def _(read):
    return read("triage_log").select("id", T.root_domain(F.col("sender_address")).alias("root_domain"))


@register("domain_reports", f"select {_root('sender_address')} as root_domain, count(*) as n from triage_log group by 1")
def _(read):
    return read("triage_log").groupBy(T.root_domain(F.col("sender_address")).alias("root_domain")).agg(F.count(F.lit(1)).alias("n"))


@register("simhash")
def _(read):
    return campaigns.simhash(read("emails"), "rec_id", "body_text").select(F.col("id").alias("rec_id"), campaigns.hex16(F.col("simhash")).alias("simhash"))


@register("campaign_ids")
def _(read):
    return campaigns.campaign_ids(read("emails"), "rec_id", "subject", "body_text", "sender_address").select(F.col("id").alias("rec_id"), "campaign_id")


def _hashed(read):
    from ..storage import materialize

    return materialize(campaigns.simhash(read("emails").where("rec_id is not null"), "rec_id", "body_text"), "mail-simhash")


@register("hamming_pairs")
def _(read):
    h = _hashed(read)
    return campaigns.near_pairs(campaigns.representatives(h)).union(campaigns.members(h).where("rec_id != rep_id").select("rep_id", "rec_id", F.lit(0).cast("bigint")))


@register("hamming_members")
def _(read):
    return campaigns.members(_hashed(read))


@register("cached_verdicts", "select t.id, c.verdict, case when c.cluster_id is not null then 'cluster' end as matched_by from triage_log t left join fast_path_cache c on t.campaign_cluster_id = c.cluster_id")
def _(read):
    from ..storage import materialize

    log, cache = read("triage_log"), read("fast_path_cache")
    mails = log.select("id", F.col("campaign_cluster_id").alias("cluster_id"), T.root_domain(F.col("sender_address")).alias("sender_domain"), T.cluster_subject(F.col("subject")).alias("subject_key"))
    # the stored hashes are opaque, so only entries of an equal hash text would be near; they come as signed longs
    hashed = cache.select(F.row_number().over(_seq()).alias("seq"), "cluster_id", "sender_domain", "normalized_subject", F.conv("simhash", 16, 10).cast("decimal(20,0)").alias("u"), "verdict")
    signed = F.when(F.col("u") >= F.lit(str(2**63)).cast("decimal(20,0)"), F.col("u") - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(F.col("u")).cast("bigint")
    body = campaigns.simhash(log, "id", "body_text")
    return campaigns.recall_verdicts(mails.join(materialize(body, "log-simhash"), "id"), hashed.withColumn("simhash", signed).drop("u")).drop("matched_cluster")


def _seq():
    from pyspark.sql import Window

    return Window.orderBy("learned_at", "cluster_id")  # the cache: a few entries a campaign


from . import io_queries, model_queries, state_queries  # noqa: E402, F401  they register more queries
