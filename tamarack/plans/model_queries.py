"""Queries of models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, features, ledger, model
from ..sources import writers
from ..storage import workspace
from ..streaming import log
from .registry import _BODY, register

# what SQL folds differs beyond ASCII, so these two take the ASCII part of the texts
_WORDS = rf"regexp_extract_all(lower(regexp_replace(coalesce(subject, '') || ' ' || {_BODY}, '[^\x00-\x7f]+', ' ', 'g')), '[a-z0-9_]{{2,}}')"


def _ascii(e: DataFrame) -> DataFrame:
    return e.select("rec_id", F.regexp_replace(F.concat(T.text("subject"), F.lit(" "), T.text("body_text")), r"[^\x00-\x7f]+", " ").alias("t"))


@register("term_weights", f"""with w as (select rec_id, {_WORDS} as w from emails), g as (select distinct rec_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as g from w),
 d as (select g as gram, count(*) as df from g group by 1 having count(*) >= 5) select gram, df, round(ln((1 + (select count(*) from emails)) / (1 + df)) + 1, 6)::double as idf from d""")
def _(read):
    e = _ascii(read("emails"))
    return model.term_weights(model.grams("t", "__grams").transform(e), "__grams", e.count(), 5)


@register("sublinear_tf", f"""with w as (select rec_id, {_WORDS} as w from emails), g as (select rec_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as g from w),
 t as (select rec_id, g, 1 + ln(count(*)) as x from g group by 1, 2) select e.rec_id, count(t.g) as terms, round(coalesce(sum(x), 0), 4)::double as mass from emails e left join t using (rec_id) group by 1""")
def _(read):
    e = _ascii(read("emails"))
    g = model.grams("t", "__grams").transform(e).select("rec_id", F.explode("__grams").alias("g")).groupBy("rec_id", "g").agg(F.count(F.lit(1)).alias("n"))
    by = g.groupBy("rec_id").agg(F.count(F.lit(1)).alias("terms"), F.sum(1 + F.ln("n")).alias("mass"))
    return e.select("rec_id").join(by, "rec_id", "left").select("rec_id", F.coalesce("terms", F.lit(0)).alias("terms"), F.round(F.coalesce("mass", F.lit(0.0)), 4).alias("mass"))


_Q = "greatest(1e-7, least(1 - 1e-7, phishing_prob))"


@register("calibrated_scores", f"select id, round(1 / (1 + exp(-(2.5 * phishing_prob - 1.25))), 6)::double as platt, round(1 / (1 + exp(-ln({_Q} / (1 - {_Q})) / 1.7)), 6)::double as warm from triage_log where phishing_prob is not null")
def _(read):
    s = read("triage_log").where("phishing_prob is not null").select("id", F.col("phishing_prob").alias("p"))
    a = model.calibrated(s, "platt", a=2.5, b=-1.25).withColumnRenamed("p", "platt")
    return a.join(model.calibrated(s, "temperature", t=1.7).withColumnRenamed("p", "warm"), "id")


@register("linear_attribution", "with m as (select avg(url_count) as u, avg(body_length) as b from (select len(coalesce(urls, [])) as url_count, length(coalesce(body_text, '')) as body_length from emails)) select rec_id, round(0.3 * (len(coalesce(urls, [])) - m.u), 4)::double as url_count, round(-0.001 * (length(coalesce(body_text, '')) - m.b), 4)::double as body_length from emails, m")
def _(read):
    e = read("emails").select("rec_id", F.size(F.coalesce("urls", F.array().cast("array<string>"))).alias("url_count"), F.length(T.text("body_text")).alias("body_length"))
    mean = e.agg(F.avg("url_count"), F.avg("body_length")).first()
    a = model.linear_attribution(e, [0.3, -0.001], [mean[0] or 0.0, mean[1] or 0.0], ["url_count", "body_length"])
    return a.select("rec_id", *[F.round(F.col("attributions")[c], 4).alias(c) for c in ("url_count", "body_length")])


@register("promotions", """with r as (select model_version as version, count(*) filter (where lower(analyst_label) = 'phishing' and predicted_label = 'phishing') / greatest(count(*) filter (where lower(analyst_label) = 'phishing'), 1) as recall from triage_log where model_version is not null and analyst_label is not null group by 1)
select version, round(recall, 6)::double as recall, recall >= coalesce(max(recall) over (order by version rows between unbounded preceding and 1 preceding), 0) as promoted from r""")
def _(read):
    t = read("triage_log").where("model_version is not null and analyst_label is not null")
    pos = F.lower("analyst_label") == "phishing"
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    recall = t.groupBy("model_version").agg((n(pos & (F.col("predicted_label") == "phishing")) / F.greatest(n(pos), F.lit(1))).alias("recall"))
    book = model.Registry(t.sparkSession, workspace(t.sparkSession, "models"))
    for r in recall.orderBy("model_version").limit(1000).collect():  # one row a model version
        book.record(r["model_version"], {"recall": r["recall"]})
        book.promote(r["model_version"])
    return book.promotions().drop("at")


def _labelled(read) -> DataFrame:
    e = read("emails").where("label in ('spam', 'phishing') and split in ('train', 'val', 'test')")
    f = features.features(e, ("rec_id", "label", "split", "subject", "body_text"))
    return f.select("*", F.concat(T.text("subject"), F.lit(" "), T.text("body_text")).alias("text"), (F.col("label") == "phishing").cast("double").alias("y"), (F.col("split") == "val").alias("valid"))


@register("text_classifier")
def _(read):
    """The measures of a logistic model of text and columns on the test split."""
    rows = _labelled(read)
    m = model.fit_text(rows.where("split = 'train'"), size=5_000)
    return evaluation.auc(m.score(rows.where("split = 'test'")).select(F.col("y").cast("int").alias("y"), "p"))


@register("coefficients")
def _(read):
    rows = _labelled(read)
    m = model.fit_text(rows.where("split = 'train'"), size=5_000)
    return rows.sparkSession.createDataFrame(model.top_coefficients(m), "name string, coefficient double")


@register("boosted_trees")
def _(read):
    """Boosted trees with early stopping on the val split: trees kept and the loss there after each, as events."""
    rows = _labelled(read).where("split in ('train', 'val')")
    m = model.fit_text(rows, trees=True, valid="valid", size=200, rounds=12)
    losses = m.losses(rows.where("valid"))
    return writers.event_lines(rows.sparkSession.createDataFrame([(i + 1, float(x), m.trees()) for i, x in enumerate(losses)], "tree int, loss double, kept int"))


# ---- streams -----------------------------------------------------------------------------------------------------
def _stream(df: DataFrame, per_trigger: int = 2) -> tuple[DataFrame, str]:
    """The table as a stream of its files, and a folder for checkpoints."""
    path = workspace(df.sparkSession, "stream")
    df.repartition(4).write.parquet(f"{path}/in")
    return log.table(df.sparkSession, f"{path}/in", df.schema, per_trigger), path


@register("stream_counts", "select predicted_label, count(*) as n from triage_log group by 1")
def _(read):
    s, path = _stream(read("triage_log").select("predicted_label"))
    return log.run_once(log.counts(s, "predicted_label"), f"counts_{abs(hash(path))}", "complete", f"{path}/check")


@register("stream_windows", "select epoch(w)::bigint as start, count(*) as n, coalesce(sum((agreement = 0)::int), 0)::bigint as overrides from (select unnest(generate_series(date_trunc('day', r) - interval 6 day, date_trunc('day', r), interval 1 day)) as w, agreement from (select make_timestamp(epoch_us(reviewed_at)) as r, agreement from triage_log where reviewed_at is not null)) group by 1")
def _(read):
    s, path = _stream(read("triage_log").where("reviewed_at is not null").select("reviewed_at", "agreement"))
    w = log.run_once(log.windowed(s, "reviewed_at", "10000 days"), f"windows_{abs(hash(path))}", "complete", f"{path}/check")
    return w.select(F.unix_seconds("start").alias("start"), "n", F.coalesce("overrides", F.lit(0)).alias("overrides"))


@register("stream_first_sightings", "select distinct email_id from triage_log where email_id is not null")
def _(read):
    s, path = _stream(read("triage_log").where("email_id is not null").select("email_id", "received_at"))
    first = log.first_sightings(s, "email_id", "received_at", "10000 days")
    log.finish(first.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/check")
    return first.sparkSession.read.parquet(f"{path}/out").select("email_id")


@register("stream_upsert", "select email_id, arg_max(id, (received_at, id)) as id from triage_log where email_id is not null group by 1")
def _(read):
    s, path = _stream(read("triage_log").select(*ledger.names(ledger.REPORT)))
    book = ledger.Ledger(s.sparkSession, f"{path}/ledger")
    log.finish(log.upsert(s, book, F.col("email_id")), f"{path}/check")
    return book.state().select("email_id", "id")


@register("stream_recall", "select t.id, c.verdict from triage_log t left join fast_path_cache c on c.cluster_id = t.campaign_cluster_id")
def _(read):
    cache = read("fast_path_cache")
    s, path = _stream(read("triage_log").select("id", F.col("campaign_cluster_id").alias("cluster_id"), F.lit("").alias("sender_domain"), F.lit("").alias("subject_key"), F.lit(0).cast("bigint").alias("simhash")))
    memory, out = ledger.Memory(s.sparkSession, f"{path}/memory"), log.BatchTable(s.sparkSession, f"{path}/found")
    memory.remember("1", cache.withColumn("seq", F.xxhash64("cluster_id")))
    log.finish(log.recall_into(s, memory, out), f"{path}/check")
    return out.read("found", "id bigint, verdict string, matched_cluster string, matched_by string").select("id", "verdict")
