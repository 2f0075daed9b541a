import datetime
import decimal
import json

from pyspark.sql import functions as F

from tamarack import storage
from tamarack.operators import ledger
from tamarack.sources import mailbox, readers, writers
from tamarack.streaming import log

RAW = b"From: \"Ann Bee\" <ann@x.example>\r\nTo: b@y.example\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nReply-To: c@z.example\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nsee http://a.example/x\r\n--q\r\nContent-Type: application/pdf; name=a.pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nxx\r\n--q--\r\n"


def test_mail_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.eml").write_bytes(RAW)
    (tmp_path / "note.txt").write_text("From: no@mail")
    (tmp_path / "empty.eml").write_bytes(b"")  # an empty file is no message
    rows = {r["subject"]: r for r in readers.read_mail(spark, str(tmp_path), "s").collect()}
    r = rows["Grüße"]
    assert len(rows) == 1 and (r["sender_display_name"], r["sender_address"], r["reply_to"]) == ("Ann Bee", "ann@x.example", "c@z.example")
    assert r["urls"] == ["http://a.example/x"] and r["attachments"][0]["filename"] == "a.pdf" and r["headers"]["To"] == "b@y.example"


def test_index(spark, tmp_path):
    for n, sub in enumerate(("a", "b", "c"), 1):  # one basename in every folder
        (tmp_path / "data" / sub).mkdir(parents=True)
        (tmp_path / "data" / sub / "inmail.1").write_bytes(f"From: a@b.example\r\nSubject: s{n}\r\n\r\nx".encode())
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "near.eml").write_bytes(b"From: a@b.example\r\nSubject: s4\r\n\r\nx")
    (tmp_path / "full" / "index").write_text("spam ../data/a/inmail.1\nham ../data/b/inmail.1\nspam too many words\nspam ./near.eml\nspam ../data/gone.1\nspam data/c/./../c/inmail.1\n")
    assert {r["subject"] for r in readers.read_index(spark, str(tmp_path / "full" / "index"), str(tmp_path)).collect()} == {"s1", "s3", "s4"}


class Box:
    """A mailbox of five messages with the interface of imaplib."""

    peeked = []

    def __init__(self, host, port):
        assert (host, port) == ("h", 993)

    def login(self, user, password):
        assert (user, password) == ("u", "p")

    def select(self, folder, readonly):
        assert folder == "INBOX" and readonly

    def search(self, charset, what):
        return "OK", [b"1 2 3 4 5"]

    def fetch(self, i, what):
        assert what == "(BODY.PEEK[])"
        return "OK", [(b"x", f"From: a@b.example\r\nSubject: s{i}\r\n\r\nx".encode()), b")"]

    def logout(self):
        pass


def test_mailbox_source():
    reader = mailbox.ImapReader({"host": "h", "user": "u", "password": "p", "limit": "3", "per_task": "2", "client": f"{__name__}.Box"})
    parts = reader.partitions()
    assert [p.ids for p in parts] == [["5", "4"], ["3"]]
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[0] for r in rows] == ["imap:5", "imap:4", "imap:3"] and readers.parse_mail(rows[0][1])["subject"] == "s5"
    assert list(reader.read(mailbox.Messages([]))) == []


def test_batch_tables(spark, tmp_path):
    t = storage.BatchTable(spark, str(tmp_path / "t"))
    one = spark.range(3)
    assert t.batches() == [] and t.read("x", "id bigint").count() == 0
    assert t.append("a", x=one) and not t.append("a", x=one) and t.append("b", x=one, y=one)
    (tmp_path / "t" / "aside-crashed" / "x").mkdir(parents=True)  # a batch that never came to be
    assert t.batches() == ["a", "b"] and t.read("x", "id bigint").count() == 6 and t.read("y", "id bigint").count() == 3
    t.clear()
    assert t.batches() == []


def test_ledger_and_memory(spark, tmp_path):
    cols = [c for c in ledger.names(ledger.REPORT)]
    row = lambda **x: tuple({**dict.fromkeys(cols), "received_at": datetime.datetime(2026, 1, 1), **x}[c] for c in cols)
    df = lambda *rows: spark.createDataFrame(list(rows), ledger.REPORT)
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    assert book.save("1", df(row(id=1, email_id="m", subject="a", body_text="b", model_version="v1", campaign_cluster_id="camp"), row(id=2, email_id=None), row(id=3, email_id="n", subject="hello", body_text="x y z", sender_address="a@b.example")))
    assert book.save("2", df(row(id=4, email_id="m", subject="c", model_version="v2", campaign_cluster_id=""))) and not book.save("2", df(row(id=9, email_id="q")))
    got = {r["email_id"]: r for r in book.state().collect()}
    assert set(got) == {"m", "n"} and (got["m"]["subject"], got["m"]["model_version"], got["m"]["campaign_cluster_id"]) == ("c", "v1", "camp")
    assert got["n"]["campaign_cluster_id"].startswith("camp_") and [r["id"] for r in book.find("m").collect()] == [4] and book.find("none").count() == 0
    mem = ledger.Memory(spark, str(tmp_path / "m"))
    sig = lambda c, v, h, seq: (c, h, "s", "d", v, "an", None, "t", seq)
    mem.remember("1", spark.createDataFrame([sig("c1", " Phishing ", "00000000000000ff", 1), sig("c2", "spam", "ffffffffffffffff", 2), sig(None, "x", "0" * 16, 3)], ledger.SIGNATURE))
    mem.remember("2", spark.createDataFrame([sig("c1", "spam", "0" * 16, 4)], ledger.SIGNATURE))
    assert {(r["cluster_id"], r["verdict"], r["simhash"]) for r in mem.entries().collect()} == {("c1", "spam", "00000000000000ff"), ("c2", "spam", "ffffffffffffffff")}
    mails = spark.createDataFrame([(1, "c2", "q", "q", 0), (2, "", "d", "s", 0xF0), (3, "", "d", "s", -1), (4, "", "e", "s", 0xFF), (5, None, None, None, None)], "id bigint, cluster_id string, sender_domain string, subject_key string, simhash bigint")
    assert {r["id"]: (r["matched_cluster"], r["matched_by"]) for r in mem.lookup(mails).collect()} == {1: ("c2", "cluster"), 2: ("c1", "near"), 3: ("c2", "near"), 4: (None, None), 5: (None, None)}
    assert mem.hit("1", mem.lookup(mails).select(F.col("matched_cluster").alias("cluster_id"))) and {r["cluster_id"]: r["hit_count"] for r in mem.stats().collect()} == {"c1": 1, "c2": 2}
    mem.clear()
    assert mem.entries().count() == 0


def test_feed_and_sync(spark):
    rows = [(1, "<A@x>", "s"), (2, "a@x", "s"), (3, "live-3", "Order REF-77"), (4, "", "re: ref-77 again"), (5, None, None), (6, None, "plain")]
    df = spark.createDataFrame(rows, "k bigint, message_id string, subject string")
    assert sorted(r["k"] for r in ledger.feed(df, F.col("k")).collect()) == [2, 4, 5, 6]
    have = spark.createDataFrame([("<a@X>", None), (None, "REF-77")], "message_id string, subject string")
    assert sorted(r["k"] for r in ledger.not_stored(df, have).collect()) == [5, 6]


def test_synthetic_mails_repeat(spark):
    from tamarack.sources import synthetic

    once, again = (synthetic.generate(spark, {"phishing": 20, "spam": 5}).select("id", "label", "urls") for _ in range(2))
    assert once.count() == 25 and once.exceptAll(again).count() == 0 and once.where("size(urls) = 0").count() == 0
    assert synthetic.generate(spark, {"spam": 3}, seed=1).select("id").exceptAll(synthetic.generate(spark, {"spam": 3}, seed=2).select("id")).count() > 0


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Body,Class,From\n"Hi, you","line\none",PHISH,a@b.example\nx,,junk,\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), "src").orderBy("subject").collect()
    assert [(r["subject"], r["body_text"], r["label"]) for r in rows] == [("Hi, you", "line\none", "phishing"), ("x", "", "spam")]
    (tmp_path / "b.csv").write_text("label,text_combined\n" + "".join(f"{i % 2},t{i}\n" for i in range(10)))
    assert readers.read_capped_csv(spark, str(tmp_path / "b.csv"), "s", 6).groupBy("label").count().orderBy("label").collect() == [("phishing", 3), ("spam", 3)]
    (tmp_path / "c.json").write_text(json.dumps([{"subject": "s", "body": "see http://q.example", "from": "a@b.example", "label": "ham", "augmented": True}]))
    r = readers.read_json(spark, str(tmp_path / "c.json"), "k").first()
    assert (r["body_text"], r["label"], r["urls"], r["augmented"], r["source"]) == ("see http://q.example", "spam", ["http://q.example"], True, "k")
    (tmp_path / "d.jsonl").write_text('{"a": {"b": [1, "x"]}}\n\n{"a": {"b": null}}\nbroken\n')
    got = {(r["path"], r["type"], r["n"]) for r in readers.profile_json(spark, str(tmp_path / "d.jsonl")).collect()}
    assert {("a.b", "array", 1), ("a.b", "null", 1), ("a.b[]", "integer", 1), ("a.b[]", "string", 1), ("a", "object", 2)} <= got


def test_forward_and_sniff(spark):
    df = spark.createDataFrame([("Fwd: x", "o@o.example", "hello\n---------- Forwarded message ---------\nFrom: A <a@a.example>\nSubject: inner\n\nbody here"), ("plain", "p@p.example", "text")], "subject string, sender_address string, body_text string")
    a, b = readers.unwrap_forward(df).collect()
    assert tuple(a) == ("inner", "a@a.example", "body here") and tuple(b) == ("plain", "p@p.example", "text")
    kinds = readers.sniff(spark.createDataFrame([('{"a":1}',), ("From: x\n\ny",), ("hi",), (None,)], "t string"), "t")
    assert [r["kind"] for r in kinds.collect()] == ["json", "message", "body", "body"]


def test_tagged_lines_lose_nothing(spark):
    df = spark.createDataFrame([(1, decimal.Decimal("1.20"), datetime.date(2020, 1, 2), bytearray(b"\x00\xff"), float("nan"), [float("inf"), 1.5], {"k": 'q"\n'}, None)],
                               "a int, d decimal(5,2), t date, b binary, f double, l array<double>, m map<string,string>, n string")
    got = json.loads(writers.tagged_lines(df).first()["value"])
    assert got == {"a": 1, "d": {"__type__": "decimal", "value": "1.20"}, "t": {"__type__": "date", "value": "2020-01-02"}, "b": {"__type__": "bytes", "value": "AP8="}, "f": {"__type__": "float", "value": "nan"},
                   "l": [{"__type__": "float", "value": "inf"}, 1.5], "m": {"k": 'q"\n'}, "n": None}


def test_streams_equal_batches(spark, small, tmp_path):
    src = spark.read.parquet(f"{small}/triage_log.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = log.table(spark, str(tmp_path / "in"), src.schema)
    got = log.run_once(log.counts(stream, "predicted_label"), "by_label", "complete", str(tmp_path / "c1"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, src.groupBy("predicted_label").count().collect()), key=str)
    once = log.run_once(log.first_sightings(log.table(spark, str(tmp_path / "in"), src.schema), "email_id", "received_at", "10000 days"), "firsts", "append", str(tmp_path / "c2"))
    assert once.select("email_id").distinct().count() == once.count() == src.select("email_id").distinct().count()
    wins = log.run_once(log.windowed(log.table(spark, str(tmp_path / "in"), src.schema).where("reviewed_at is not null"), "reviewed_at"), "wins", "complete", str(tmp_path / "c3"))
    want = src.where("reviewed_at is not null").groupBy(F.window("reviewed_at", "7 days", "1 day")).count()
    assert sum(r["n"] for r in wins.collect()) == sum(r["count"] for r in want.collect())
