import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import grams
from tamarack.functions import text as T
from tamarack.graph import connected_components
from tamarack.operators import audit, campaigns, dedup, evaluation, features, feedback, ledger, model, sampling, tiles
from tamarack.plans import registry

MAIL = "rec_id bigint, subject string, body_text string, sender_display_name string, sender_address string, reply_to string, urls array<string>, attachments array<struct<filename:string,mime_type:string>>"


def mail(spark, **given):
    row = {"rec_id": 1, "subject": "", "body_text": "", "sender_display_name": "", "sender_address": "", "reply_to": "", "urls": [], "attachments": []} | given
    return features.features(spark.createDataFrame([tuple(row[c.split()[0]] for c in re.split(r", (?=\w+ )", MAIL))], MAIL)).first()


@pytest.mark.parametrize("given_, want", [
    ({"sender_display_name": "paypal.com admin", "sender_address": "attacker@evil.com"}, {"display_from_mismatch": True}),
    ({"sender_display_name": "John Smith", "sender_address": "john@company.com"}, {"display_from_mismatch": False}),
    ({"sender_address": "a@bank.com", "reply_to": "b@evil.com"}, {"reply_to_mismatch": True}),
    ({"sender_address": "a@bank.com", "reply_to": "b@bank.com"}, {"reply_to_mismatch": False}),
    ({}, {"missing_feature_count": 7, "url_count": 0, "domain_count": 0, "url_entropy": 0.0, "uppercase_ratio": 0.0, "link_density": 0.0}),
    ({"urls": ["http://evil.com/a", "http://evil.com/b", "http://other.com"]}, {"url_count": 3, "domain_count": 2}),
    ({"urls": ["http://192.168.1.1/phish"]}, {"ip_literal_url": True}),
    ({"urls": ["https://winner.xyz/claim"]}, {"suspicious_tld_present": True}),
    ({"urls": ["http://paypa1.com/x"]}, {"typosquatting_detected": True}),
    ({"urls": ["http://paypal.com/x"]}, {"typosquatting_detected": False}),
    ({"urls": ["http://bit.ly/x"]}, {"shortened_url_present": True}),
    ({"attachments": [("payload.exe", ""), ("report.pdf", "application/pdf")]}, {"executable_detected": True, "attachment_type": "executable,pdf"}),
    ({"attachments": [("invoice.xlsm", "")]}, {"macro_detected": True, "has_attachment": True}),
    ({"subject": "Hello World", "body_text": "a" * 500}, {"subject_length": 11, "body_length": 500}),
    ({"body_text": "see paypal", "sender_address": "x@evil.com"}, {"brand_mention": True, "sender_brand_mismatch": True}),
    ({"subject": None, "body_text": None, "sender_display_name": None, "sender_address": None, "reply_to": None, "urls": None, "attachments": None}, {"missing_feature_count": 7, "has_attachment": False, "url_count": 0}),
])
def test_boundary_rows(spark, given_, want):
    got = mail(spark, **given_)
    assert {k: got[k] for k in want} == want


def simhash_by_hand(words):
    votes = [0] * 64
    for f in words + [f"{a}_{b}" for a, b in zip(words, words[1:])]:
        h = int.from_bytes(hashlib.md5(f.encode()).digest()[:8], "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_simhash_against_a_plain_version(spark):
    texts = ["the parcel for you waits at the gate", "one", "", "a b a b a b", "word " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    got = {r["id"]: r["simhash"] & (2**64 - 1) for r in campaigns.simhash(df, "id", "t").collect()}
    clean = {r["id"]: [w for w in r["c"].split(" ") if w] for r in df.select("id", T.cluster_text(F.col("t")).alias("c")).collect()}
    assert got == {i: simhash_by_hand(clean[i]) if clean[i] else 0 for i in clean}


@pytest.mark.parametrize("subject, want", [("Re: FWD: Invoice [#123] - Ref 991", "invoice"), (None, "no_subject"), ("", "no_subject"), ("URGENT: Pay now (Ref: 1) - Account #4091-8821", "pay now")])
def test_subject(spark, subject, want):
    assert spark.createDataFrame([(subject,)], "s string").select(T.cluster_subject(F.col("s")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("n", [1, 8, 30])
def test_subject_with_many_trailing_numbers(spark, n):
    subject = "Your parcel" + " - 4091" * n + " [x] - Ref 12" * n
    assert spark.createDataFrame([(subject,)], "s string").select(T.cluster_subject(F.col("s")).alias("x")).first()["x"] == "your parcel"


def test_near_pairs_are_complete(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    hs = base + [h ^ sum(1 << i for i in r.sample(range(64), k)) for h in base for k in (1, 3, 5, 6)]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "id bigint, simhash bigint")
    got = {(x["a"], x["b"], x["distance"]) for x in campaigns.near_pairs(df).collect()}
    assert got == {(i, j, d) for i, j in itertools.combinations(range(len(hs)), 2) if (d := bin(hs[i] ^ hs[j]).count("1")) <= 5}


def test_near_pairs_of_a_slice_that_all_rows_share(spark, monkeypatch):
    """Hashes of one upper half: cut into tiles, each pair once, and no row is made of a pair before it is one."""
    monkeypatch.setattr(campaigns, "TILE_LEAST", 40)
    r = random.Random(2)
    hs = list({r.getrandbits(22) for _ in range(300)})
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "id bigint, simhash bigint")
    pairs = campaigns.near_pairs(df)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = [(i, j, d) for i, j in itertools.combinations(range(len(hs)), 2) if (d := bin(hs[i] ^ hs[j]).count("1")) <= 5]
    assert sorted((x["a"], x["b"], x["distance"]) for x in pairs.collect()) == want and len(want) > 100


def test_hamming_queries_keep_every_row(spark, tmp_path):
    body = "the parcel for you waits at the gate until noon and must be fetched by hand "
    texts = [body, body.upper(), body + "now", "short", "Short!", "", None, "a quite different matter of the yearly meeting"] + [body * 9] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rec_id bigint, body_text string")
    df.write.parquet(f"{tmp_path}/emails.parquet")
    h = {x["id"]: x["simhash"] & (2**64 - 1) for x in campaigns.simhash(df, "rec_id", "body_text").collect()}
    rep = {x["rec_id"]: x["rep_id"] for x in registry.queries()["hamming_members"](spark, str(tmp_path)).collect()}
    pairs = {(x["a"], x["b"]): x["distance"] for x in registry.queries()["hamming_pairs"](spark, str(tmp_path)).collect()}
    assert set(rep) == set(h) and all(pairs[rep[i], i] == 0 for i in rep if rep[i] != i)
    for i, j in itertools.combinations(sorted(h), 2):
        a, b = sorted((rep[i], rep[j]))
        assert (a == b or (a, b) in pairs) == (bin(h[i] ^ h[j]).count("1") <= 5)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (200, 200)]
    root = {x: x for e in edges for x in e if None not in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == root
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("order", ["rising", "star", "shuffled"])
def test_components_settle_in_few_rounds(spark, order):
    n, r = 1000, random.Random(4)
    names = list(range(n))
    if order == "shuffled":
        r.shuffle(names)
    edges = [(i, n) for i in range(n)] if order == "star" else list(zip(names, names[1:]))
    rounds: list = []
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), rounds).collect()}
    assert set(got.values()) == {0} and len(got) == n + (order == "star")
    assert len(rounds) <= 12 and sum(rounds) <= (15 if order != "shuffled" else 40)


def test_greedy_keep(spark):
    r = random.Random(5)
    ids = [(i, r.randrange(3)) for i in range(60)]
    pairs = [p for p in {tuple(sorted((r.randrange(60), r.randrange(60)))) for _ in range(70)} if p[0] != p[1]]
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i, _ in ids}
    kept: list = []
    for i, _ in sorted(ids, key=lambda x: (x[1], x[0])):
        if not near[i] & set(kept):
            kept.append(i)
    got = dedup.greedy_keep(spark.createDataFrame(ids, "id bigint, rank int"), spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {x["id"] for x in got.collect()} == set(kept)


def test_greedy_keep_broadcasts_no_ids(spark):
    ids, pairs = spark.createDataFrame([(i, 0) for i in range(9)], "id bigint, rank int"), spark.createDataFrame([(0, 1), (1, 2), (4, 8)], "a bigint, b bigint")
    got = dedup.greedy_keep(ids, pairs)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x["id"] for x in got.collect()} == {0, 2, 3, 4, 5, 6, 7}


def test_greedy_near_dedup_knows_the_links_of_equal_rows(spark, tmp_path):
    """An equal row with a near row before both, and one whose source is better than that of the smaller id: as greedy by
    brute force, and nothing whose size is bounded by the input alone is broadcast."""
    r = random.Random(12)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for _ in range(40):
        a = some(r.choice([40, 120, 300]))
        b, c = a[:-1] + "0", "1" + a[1:-1] + "0"
        texts += r.choices([a, b, c, some(60), "x", None], k=6)
    rows = [(i, t, r.choice(["kaggle", "nazario", "trec", "other", None])) for i, t in enumerate(texts)]
    rows += [(1000, "the parcel waits at the gate, fetch it", "x"), (1001, "the parcel waits at the gate, fetch it!", "x"), (1002, "the parcel waits at the gate, fetch it!", "x")]
    rows += [(1010, "a yearly meeting of all in the big hall", "x"), (1011, "a yearly meeting of all in the big hall", "nazario"), (1012, "a yearly meeting of all in the big hall.", "trec")]
    df = spark.createDataFrame(rows, "rec_id bigint, body_text string, source string").withColumn("subject", F.lit(None).cast("string"))
    df.write.parquet(f"{tmp_path}/emails.parquet")
    sets = {i: set(grams.shingles(" " + (t or "")).tolist()) for i, t, _ in rows}
    rank = {x["rec_id"]: x["k"] for x in df.select("rec_id", T.source_rank(F.col("source")).alias("k")).collect()}
    kept: list = []
    for i in sorted(sets, key=lambda i: (rank[i], i)):
        if not any(sets[i] and len(sets[i] & sets[k]) >= 0.85 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    got = registry.queries()["greedy_near_dedup"](spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(x["rec_id"] for x in got.collect()) == sorted(kept)
    assert {1000, 1011} <= set(kept) and not {1001, 1002, 1010, 1012} & set(kept) and len(kept) < len(rows) - 60


def test_near_duplicates_by_characters(spark, small):
    df = spark.read.parquet(f"{small}/emails.parquet")
    text = F.concat(T.text("subject"), F.lit(" "), T.text("body_text"))
    got = {tuple(sorted((x["a"], x["b"]))) for x in dedup.near_duplicate_pairs(df, "rec_id", text).collect()}
    sets = {x["rec_id"]: set(grams.shingles(x["t"], {}).tolist()) for x in df.select("rec_id", text.alias("t")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert got == want


def test_whole_texts_are_compared(spark):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    opening = some(1100)
    df = spark.createDataFrame([(1, opening + some(1500)), (2, opening + some(1500)), (3, "x")], "rec_id bigint, t string")
    assert dedup.near_duplicate_pairs(df, "rec_id", F.col("t")).count() == 0
    assert [(x["a"], x["b"]) for x in dedup.near_duplicate_pairs(df, "rec_id", F.col("t"), cut=1000).collect()] == [(1, 2)]


@pytest.mark.parametrize("most", [1, 3, 7, 100])
def test_tiles_hold_no_more_than_they_may(most):
    r = np.random.default_rng(9)
    counts = r.integers(0, 12, 40)
    t = tiles.Tiles(counts, most, starts=[20])
    cells = np.repeat(np.arange(40), counts)
    tile = t.of(cells, np.arange(len(cells)))
    for c, x in zip(cells, tile):
        assert t.low[x] <= c <= t.high[x] and not t.low[x] < 20 <= t.high[x]
    whole = [x for x in range(len(t.low)) if t.parts[t.low[x]] == 1]
    assert all((tile == x).sum() <= most for x in whole) and sum(counts) == len(tile)


def test_near_duplicates_are_no_rows_for_each_common_shingle(spark, monkeypatch):
    """Texts of few letters, of which each two share most shingles: found as by brute force over cut tiles, and nothing whose
    size is bounded by the input alone is broadcast."""
    monkeypatch.setattr(dedup, "TILE_LEAST", 50)
    r = random.Random(8)
    texts = ["".join(r.choice("abcdef") for _ in range(r.choice([60, 110, 140, 700]))) for _ in range(260)]
    texts += [t[:-4] + "zzzz" for t in texts[::3]] + texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    pairs = dedup.near_duplicate_pairs(df, "id", F.col("t"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    sets = [set(grams.shingles(t, {}).tolist()) for t in texts]
    rep = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    want = {(a, b) for a, b in itertools.combinations(sorted(rep.values()), 2) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    want |= {(rep[frozenset(s)], i) for i, s in enumerate(sets) if rep[frozenset(s)] != i}
    assert sorted((x["a"], x["b"]) for x in pairs.collect()) == sorted(want) and len(want) > 100


def test_pairs_at_the_threshold_are_all_found(spark):
    """Texts with letters changed until their overlap is just over 0.85: none is lost."""
    r = random.Random(7)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    sets = lambda t: set(grams.shingles(t, {}).tolist())
    over = lambda a, b: len(sets(a) & sets(b)) >= 0.85 * len(sets(a) | sets(b))
    texts = []
    for k in range(150):
        a = some(r.choice([20, 60, 200, 400]))
        b = a
        while True:
            i = r.randrange(len(b))
            c = b[:i] + r.choice("0123456789") + b[i + 1 :]
            if not over(a, c):
                break
            b = c
        texts += [a, b]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {(x["a"], x["b"]) for x in dedup.near_duplicate_pairs(df, "id", F.col("t")).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if over(texts[i], texts[j])} and len(got) >= 150


def test_budgeted_sample_keeps_its_budgets(spark, small):
    df = spark.read.parquet(f"{small}/emails.parquet").where("label in ('spam', 'phishing')")
    rows = sampling.budgeted(df, 16, 24, {"legacy": 0.35, "mid": 0.45, "recent": 0.6}).collect()
    for label in ("spam", "phishing"):
        mine = [r for r in rows if r["label"] == label]
        assert 0 < len(mine) <= 24
        assert all(sum(r["source"] == s for r in mine) <= 8 for s in {r["source"] for r in mine})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.3, 0.5, 0.77, 1.0])), min_size=1, max_size=40))
def test_auc_counts_pairs(spark, rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    got = evaluation.auc(spark.createDataFrame(rows, "y int, p double")).first()["roc_auc"]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got == pytest.approx(want) if want is not None else got is None


def test_feedback_cases(spark):
    cols = "id bigint, email_id string, agreement int, analyst_label string, predicted_label string, reviewed_at timestamp, received_at timestamp, trust_score double, routed_to_review int"
    at = "2026-01-10 00:00:00"
    rows = [(i, f"m{i}", int(i >= 21), "phishing", "phishing", None, None, 50.0, 0) for i in range(100)] + [(200, "old", 0, "spam", "phishing", None, None, 50.0, 0), (201, "d", 0, "Defer", "phishing", None, None, 50.0, 0)]
    log = spark.createDataFrame(rows, cols).withColumn("reviewed_at", F.when(F.col("id") == 200, F.lit("2026-01-01")).otherwise(F.lit(at)).cast("timestamp"))
    got = feedback.override_rate(log).first()
    assert (got["reviewed"], got["overrides"], got["rate"]) == (100, 21, 0.21)
    assert feedback.override_rate(log.limit(0)).first()["rate"] == 0.0
    assert feedback.traffic(log.limit(0)).first()["avg_trust"] == 100.0


def test_text_model_learns_and_stops_early(spark):
    r = random.Random(5)
    rows = [(f"{'Vérify your àccount' if y else 'buy new shoes'} word{r.randrange(5)} filler{r.randrange(9)}", float(y), r.random(), k % 4 == 0) for k in range(120) for y in (0, 1)]
    df = spark.createDataFrame(rows, "text string, y double, url_count double, valid boolean")
    m = model.fit_text(df.where("not valid"), names=["url_count"], size=300)
    assert evaluation.auc(m.score(df.where("valid")).select(F.col("y").cast("int").alias("y"), "p")).first()["roc_auc"] > 0.95
    top = model.top_coefficients(m, 5)
    assert len(top) == 10 and any("account" in n or "verify" in n for n, _ in top[:5]) and top[0][1] > 0 > top[-1][1]
    trees = model.fit_text(df, names=["url_count"], trees=True, valid="valid", size=100, rounds=8)
    assert 1 <= trees.trees() <= 8 and len(trees.losses(df.where("valid"))) == trees.trees()
    assert m.score(spark.createDataFrame([(None, 0.0, None, True), ("", 1.0, 1.0, True)], "text string, y double, url_count double, valid boolean")).where("p is null").count() == 0


def test_accents_fold_in_every_script(spark):
    texts = ["Příliš žluťoučký kůň", "Zażółć", "Ελληνικά ΰ", "ｆｕｌｌ 𝖬𝖺𝖾", "e\u0301t", None, "straße"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(model.fold(T.text("t")).alias("x")).collect()]
    assert got == ["prilis zlutoucky kun", "zazołc", "ελληνικα υ", "full Mae", "et", "", "straße"]


def test_linear_quantiles(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=501), r.integers(0, 4, 200).astype(float)
    rows = [("a", float(x)) for x in a] + [(None, float(x)) for x in b] + [("c", 5.0), ("d", None)]
    got = {x["g"]: x["points"] for x in audit.linear_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], (0.0, 0.01, 0.5, 0.99, 1.0)).collect()}
    assert set(got) == {"a", None, "c"} and got["c"] == [5.0] * 5
    for k, x in (("a", a), (None, b)):
        assert got[k] == pytest.approx(np.percentile(x, [0, 1, 50, 99, 100]))


def test_gates_of_an_empty_table(spark):
    schema = "label string, source string, augmented boolean, url_count bigint, body_length bigint, shortened_url_present boolean, suspicious_tld_present boolean, display_from_mismatch boolean, reply_to_mismatch boolean, free_email_sender boolean"
    got = {x["gate"]: (x["value"], x["passed"]) for x in audit.gates(spark.createDataFrame([], schema)).collect()}
    assert got["synthetic_ratio"] == (1.0, False) and got["structural_coverage"] == (0.0, False) and got["overall"] == (0.0, False)
    rows = [("spam", "a", False, 0, 5, False, False, False, False, False)] * 2 + [("phishing", s, None, 1, None, None, None, None, None, None) for s in "abc"]
    got = {x["gate"]: x["passed"] for x in audit.gates(spark.createDataFrame(rows, schema), spam=2, phishing=3).collect()}
    assert all(got.values()) and len(got) == 6


def test_retrain_set(spark):
    train = spark.createDataFrame([("x", "spam", 1.0), ("y", "", 2.0)], "body_text string, label string, url_count double")
    judged = spark.createDataFrame([("z", "phishing", {"url_count": 3.0}, 1), ("q", "phishing", {}, 2), ("w", "other", {"a": 1.0}, 3), (None, "spam", {"a": 1.0}, 4), ("n", "spam", None, 5)], "body_text string, label string, features map<string,double>, extra int")
    got = ledger.retrain_set(train, judged, columns=["url_count"])
    assert got.columns == train.columns and sorted(map(tuple, got.collect()), key=str) == sorted([("x", "spam", 1.0), ("z", "phishing", 3.0), (None, "spam", 0.0)], key=str)


def test_model_and_calibration(spark, tmp_path):
    r = random.Random(2)
    rows = [(float(y), f"{'verify your account' if y else 'buy new shoes'} word{r.randrange(5)}", float(y) + r.random() * 0.4, r.random()) for y in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "y double, t string, url_count double, digit_ratio double")
    vec, weights = model.tfidf(df, "t", 100, 2)
    one = model.weighted(vec, weights, df).select("tfidf").first()["tfidf"]
    assert sum(x * x for x in one.values) == pytest.approx(1.0)
    fitted = model.numeric_pipeline(["url_count", "digit_ratio"], n=len(rows)).fit(df)
    scored = model.probability(fitted.transform(df)).select("y", "p")
    a, b = model.platt(scored)
    assert a > 0 and b < a
    assert 0.1 <= model.temperature(scored) <= 10
    reg = model.Registry(spark, str(tmp_path / "reg"))
    reg.save("v1", fitted, {"recall": 0.9})
    assert reg.promote("v1") and reg.current()["version"] == "v1"
    reg.save("v2", fitted, {"recall": 0.5})
    assert not reg.promote("v2") and reg.load() is not None
    assert sorted((r["version"], r["promoted"]) for r in reg.promotions().collect()) == [("v1", True), ("v2", False)]
