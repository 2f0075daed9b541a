"""Readers that bring raw mail in any of its forms to one record type."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

RECORD = """id string, subject string, body_text string, body_html string, sender_display_name string, sender_address string, reply_to string,
headers map<string,string>, urls array<string>, attachments array<struct<filename:string,mime_type:string>>, label string, source string, era_bucket string, subtype string, augmented boolean"""
# Column names under which exports keep each field.
ALIASES = {
    "subject": ["subject", "title", "email_subject"],
    "body_text": ["body", "text", "body_text", "email_text", "message", "content", "email", "email text"],
    "label": ["label", "class", "category", "type", "spam", "is_phishing", "email type"],
    "sender_address": ["sender", "from", "from_address", "sender_address", "sender_email"],
    "reply_to": ["reply_to", "reply-to", "replyto"],
}
SKIPPED = (".zip", ".gz", ".tar", ".bz2", ".rar", ".7z", ".json", ".csv", ".txt", ".md", ".py", ".ipynb")


def complete(df: DataFrame) -> DataFrame:
    """All record fields, absent ones empty; the id is made where it is missing; URLs come from the body where none are given."""
    have = {c.lower() for c in df.columns}
    text = ["subject", "body_text", "body_html", "sender_display_name", "sender_address", "reply_to", "label", "source", "era_bucket", "subtype"]
    df = df.withColumns({c: T.text(F.col(c).cast("string")) if c in have else F.lit("") for c in text})
    no_urls, no_files, no_heads = (F.array().cast("array<string>"), F.array().cast("array<struct<filename:string,mime_type:string>>"), F.create_map().cast("map<string,string>"))
    given = F.coalesce(F.col("urls"), no_urls) if "urls" in have else no_urls
    df = df.withColumns({
        "urls": F.when(F.size(given) > 0, given).otherwise(T.urls_of(F.col("body_text"))),
        "attachments": F.coalesce(F.col("attachments"), no_files) if "attachments" in have else no_files, "headers": F.coalesce(F.col("headers"), no_heads) if "headers" in have else no_heads,
        "augmented": F.coalesce(F.col("augmented"), F.lit(False)) if "augmented" in have else F.lit(False)})
    made = T.mail_id(F.col("subject"), F.col("body_text"))
    df = df.withColumn("id", F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), made) if "id" in have else made)
    names = [f.name for f in SparkSession.active().createDataFrame([], RECORD).schema]
    return df.select(*names)


def resolve(df: DataFrame, field: str) -> Column:
    """The first column, in file order, whose name is an alias of the field; an empty string where none is."""
    for c in df.columns:
        if c.strip().lower() in ALIASES[field]:
            return T.text(F.col(f"`{c}`").cast("string"))
    return F.lit("")


def read_csv(spark: SparkSession, path: str, source: str = "", default_label: str = "", max_rows: int | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV export under any of the known headings; quoted line breaks and broken bytes are kept readable. A file
    without quoted line breaks is read in splits with multi_line=False. max_rows: no more rows than that."""
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE")
    raw = raw if max_rows is None else raw.limit(max_rows)
    cols = {f: resolve(raw, f) for f in ALIASES}
    label = T.label_of(cols["label"])
    return complete(raw.select(*[c.alias(f) for f, c in cols.items() if f != "label"], F.when(label == "", F.lit(default_label)).otherwise(label).alias("label"), F.lit(source).alias("source")))


def read_inverted_csv(spark: SparkSession, path: str, source: str, most: int) -> DataFrame:
    """Rows whose label is 1, as spam, up to `most` of them."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return complete(raw.where(F.trim(resolve(raw, "label")) == "1").limit(most).select(*[resolve(raw, f).alias(f) for f in ("subject", "body_text", "sender_address", "reply_to")], F.lit("spam").alias("label"), F.lit(source).alias("source"), F.lit("mid").alias("era_bucket")))


def read_capped_csv(spark: SparkSession, path: str, source: str, most: int, text_col: str = "text_combined") -> DataFrame:
    """One text column and a 0/1 label: at most half of `most` rows of each label, in file order."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.col(text_col).alias("body_text"), F.when(F.trim(T.text(F.col("label").cast("string"))) == "1", "phishing").otherwise("spam").alias("label")).withColumn("pos", F.monotonically_increasing_id())
    rn = F.row_number().over(W.partitionBy("label").orderBy("pos"))
    return complete(raw.withColumn("rn", rn).where(F.col("rn") <= most // 2).select("body_text", "label", F.lit(source).alias("source")))


def read_json(spark: SparkSession, path: str, source: str = "", lines: bool = False) -> DataFrame:
    """Objects, or an array of them, or lines; older field names fill gaps."""
    raw = spark.read.json(path, multiLine=not lines)
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(""))
    extra = {c: F.col(c) for c in ("urls", "attachments", "headers", "augmented", "id", "era_bucket", "subtype", "body_html", "sender_display_name", "reply_to") if c in have}
    return complete(raw.select(pick("subject").alias("subject"), pick("body_text", "body").alias("body_text"), pick("sender_address", "from").alias("sender_address"), T.label_of(pick("label")).alias("label"),
                               F.when(pick("source") != "", pick("source")).otherwise(F.lit(source)).alias("source"), *[c.alias(n) for n, c in extra.items()]))


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV, Parquet, else JSON lines."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    return spark.read.parquet(path) if low.endswith(".parquet") else spark.read.json(path)


def parse_mail(raw: bytes) -> dict | None:
    """One RFC 822 message as a record dict; None if it is no message. The first plain and first HTML part win."""
    import email
    import re
    from email import policy

    try:
        m = email.message_from_bytes(raw, policy=policy.compat32)
    except Exception:
        return None
    decode = lambda v: str(email.header.make_header(email.header.decode_header(v))) if v else ""

    def safe(v: str | None) -> str:
        try:
            return decode(v)
        except Exception:
            return str(v or "")

    plain, html, files = "", "", []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type()
        if "attachment" in str(part.get("Content-Disposition") or "").lower():
            files.append({"filename": safe(part.get_filename()), "mime_type": kind})
            continue
        if kind in ("text/plain", "text/html"):
            data = part.get_payload(decode=True) or b""
            try:
                text = data.decode(part.get_content_charset() or "utf-8", errors="replace")
            except LookupError:
                text = data.decode("utf-8", errors="replace")
            if kind == "text/plain" and not plain:
                plain = text
            elif kind == "text/html" and not html:
                html = text
    sender = safe(m.get("From"))
    hit = re.match(r'^"?([^"<]+)"?\s*<([^>]+)>', sender)
    name, address = (hit.group(1).strip(), hit.group(2).strip()) if hit else ("", sender.strip())
    return {"subject": safe(m.get("Subject")), "body_text": plain, "body_html": html, "sender_display_name": name, "sender_address": address, "reply_to": safe(m.get("Reply-To")),
            "headers": {k: str(v) for k, v in m.items()}, "attachments": files, "urls": re.findall(r"https?://[^\s<>\"']+", plain + html)}


MIME = "path string, subject string, body_text string, body_html string, sender_display_name string, sender_address string, reply_to string, headers map<string,string>, attachments array<struct<filename:string,mime_type:string>>, urls array<string>"


def parse_files(files: DataFrame) -> DataFrame:
    """binaryFile rows -> parsed messages with their path; what cannot be parsed is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p} | r for p, c in zip(b["path"], b["content"]) if (r := parse_mail(bytes(c))) is not None]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in MIME.split(", ") if " " in f])

    return files.select("path", "content").mapInPandas(run, MIME)


def read_mail(spark: SparkSession, path: str, source: str = "", label: str = "", era: str = "") -> DataFrame:
    """All messages below a folder, other known file kinds skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")$"))
    return complete(parse_files(files).withColumns({"source": F.lit(source), "label": F.lit(label), "era_bucket": F.lit(era)}))


def plain_path(c: Column) -> Column:
    """A path without scheme, doubled slashes and dot steps; `..` takes the step before it away."""
    parts = F.filter(F.split(F.regexp_replace(c, r"^[A-Za-z]+:(?=/)", ""), "/+"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def read_index(spark: SparkSession, index: str, folder: str, source: str = "trec") -> DataFrame:
    """Messages that an index of `spam|ham path` lines calls spam; lines of another form are skipped, ham is left out.

    A path counts from the folder, leading dots and slashes taken off, and where no file is there from the index file's
    own folder; files of one name in different folders are different files.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    listed = spark.read.text(index).select(parts.alias("p")).where((F.size("p") == 2) & (F.get("p", F.lit(0)) == "spam")).select(F.get("p", F.lit(1)).alias("rel")).distinct()
    home = index.rstrip("/").rsplit("/", 1)[0]
    wanted = listed.select("rel", F.explode(F.array(F.struct(F.lit(0).alias("rank"), plain_path(F.concat(F.lit(folder + "/"), F.ltrim("rel", F.lit("./")))).alias("at")),
                                                   F.struct(F.lit(1).alias("rank"), plain_path(F.concat(F.lit(home + "/"), "rel")).alias("at")))).alias("x")).select("rel", "x.*")
    inside = lambda a, b: f"{a}/".startswith(f"{b.rstrip('/')}/")
    roots = [folder] if inside(home, folder) else [home] if inside(folder.rstrip("/"), home) else [folder, home]  # each file once
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    there = files.select(plain_path(F.col("path")).alias("at")).distinct()
    best = wanted.join(there, "at").groupBy("rel").agg(F.min_by("at", "rank").alias("at")).select("at").distinct()
    found = files.withColumn("at", plain_path(F.col("path"))).join(best, "at", "left_semi")
    return complete(parse_files(found).withColumns({"source": F.lit(source), "label": F.lit("spam"), "era_bucket": F.lit("legacy")}))


def unwrap_forward(df: DataFrame) -> DataFrame:
    """Subject, sender and body of the forwarded message where a mail is a forward; other rows stay."""
    mark = r"(?m)^-{3,} *(?:Forwarded message|Original Message) *-{3,}\s*$"
    parts = F.split(F.col("body_text"), mark, 2)
    inner = F.get(parts, F.lit(1))
    subject, sender = F.trim(F.regexp_extract(inner, r"(?im)^Subject: *(.*)$", 1)), F.trim(F.regexp_extract(inner, r"(?im)^From: *(.*)$", 1))
    body = F.try_element_at(F.split(F.ltrim(inner, F.lit("\r\n ")), r"\r?\n\s*\r?\n", 2), F.lit(-1))
    forward = F.size(parts) > 1
    bare = F.regexp_replace(F.col("subject"), r"(?i)^(?:fwd?|forward):\s*", "")
    address = F.when(sender.rlike("<[^>]+>"), F.regexp_extract(sender, "<([^>]+)>", 1)).otherwise(sender)
    return df.withColumns({"subject": F.when(forward & (subject != ""), subject).otherwise(bare), "sender_address": F.when(forward & (address != ""), address).otherwise(F.col("sender_address")), "body_text": F.when(forward, body).otherwise(F.col("body_text"))})


def sniff(df: DataFrame, col: str) -> DataFrame:
    """`kind` of pasted text: json, message (it opens with mail headers) or body."""
    t = F.ltrim(T.text(col))
    return df.withColumn("kind", F.when(t.startswith("{"), "json").when(t.rlike(r"(?im)^(?:from|subject):"), "message").otherwise("body"))


def parse_pasted(df: DataFrame, col: str) -> DataFrame:
    """(..., kind, subject, body_text, sender_address) of pasted text: fields of a JSON object, headers and body of a
    message, or the text itself as the body. JSON that does not parse is a body."""
    t = T.text(col)
    obj = F.from_json(F.when(F.ltrim(t).startswith("{"), t), "subject string, body_text string, body string, sender_address string, `from` string, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    df = sniff(df, col).withColumn("__o", obj)
    good = (F.col("kind") == "json") & F.col("__o").isNotNull() & F.col("__o.__bad").isNull()
    kind = F.when((F.col("kind") == "json") & ~good, "body").otherwise(F.col("kind"))
    head = F.get(F.split(F.ltrim(t), r"\r?\n\s*\r?\n", 2), F.lit(0))
    rest = F.get(F.split(F.ltrim(t), r"\r?\n\s*\r?\n", 2), F.lit(1))
    field = lambda n: F.trim(F.regexp_extract(head, rf"(?im)^{n}:[ \t]*(.*?)\r?$", 1))
    pick = lambda j, m, b: F.when(kind == "json", F.coalesce(*[F.col(f"__o.{x}") for x in j], F.lit(""))).when(kind == "message", m).otherwise(b)
    return df.withColumns({"subject": pick(["subject"], field("Subject"), F.lit("")), "body_text": pick(["body_text", "body"], F.coalesce(rest, F.lit("")), t), "sender_address": pick(["sender_address", "from"], field("From"), F.lit("")), "kind": kind}).drop("__o")


def requests(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """Requests to records: defaults for absent fields, the name taken out of the address where none is given, URLs from
    the body where none are given, and `explicit`, a map of the features that the caller set, which override computed ones."""
    have = set(df.columns)
    col = lambda *ns: F.coalesce(*[F.col(n).cast("string") for n in ns if n in have], F.lit(""))
    sender, shown = col("sender_address", "from_addr"), col("sender_display_name")
    split = (shown == "") & sender.rlike(r'^"?([^"<]+)"?\s*<([^>]+)>')
    part = lambda k: F.trim(F.regexp_extract(sender, r'^"?([^"<]+)"?\s*<([^>]+)>', k))
    given = [n for n in feature_names if n in have]
    explicit = F.map_filter(F.create_map(*[x for n in given for x in (F.lit(n), F.col(n).cast("double"))]), lambda k, v: v.isNotNull()) if given else F.create_map().cast("map<string,double>")
    rows = df.withColumns({"__s": F.when(split, part(2)).otherwise(sender), "__n": F.when(split, part(1)).otherwise(shown), "explicit": explicit})
    base = rows.drop(*[c for c in ("sender_address", "sender_display_name") if c in have]).withColumnsRenamed({"__s": "sender_address", "__n": "sender_display_name"})
    urls = F.coalesce(F.col("urls"), F.array().cast("array<string>")) if "urls" in have else F.array().cast("array<string>")
    return base.withColumns({"subject": col("subject"), "body_text": col("body_text"), "reply_to": col("reply_to"), "urls": F.when(F.size(urls) > 0, urls).otherwise(T.urls_of(col("body_text")))})


def overridden(df: DataFrame, names: list[str]) -> DataFrame:
    """Computed features, replaced where `explicit` names them."""
    return df.withColumns({n: F.coalesce(F.try_element_at("explicit", F.lit(n)), F.col(n).cast("double")) for n in names if n in df.columns})


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """All rows of several record tables, columns by name, absent ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def lookup_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a lookup file, trimmed, without blank and comment ones."""
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(F.trim("value").alias("value")).where("value <> ''")


def lookup_values(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """The lines as a list for expressions; an error beyond `most` of them."""
    rows = lookup_lines(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path}: more than {most} values, join with lookup_lines instead")
    return [r["value"] for r in rows]


def catalogue(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(name, path, available, train, val, test): lines of the split files of each folder; absent ones count 0, and a
    folder is available if all three are there."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = lambda x: p(x).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p(x))
    out = None
    for name, folder in folders.items():
        files = {s: f"{folder.rstrip('/')}/{s}.jsonl" for s in ("train", "val", "test")}
        there = {s: fs(f) for s, f in files.items()}
        row = spark.range(1).select(F.lit(name).alias("name"), F.lit(folder).alias("path"), F.lit(all(there.values())).alias("available"))
        for s, f in files.items():
            n = spark.read.text(f).agg(F.count(F.lit(1)).alias(s)) if there[s] else spark.range(1).select(F.lit(0).cast("bigint").alias(s))
            row = row.crossJoin(n)  # one-row tables
        out = row if out is None else out.union(row)
    return out


def profile_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, n) of every field of JSON lines: arrays as name[], all observed types kept side by side."""
    import json

    def walk(v: object, at: str) -> Iterator[tuple[str, str]]:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(v)]
        yield at, kind
        for k, x in v.items() if isinstance(v, dict) else ():
            yield from walk(x, f"{at}.{k}" if at else k)
        for x in v if isinstance(v, list) else ():
            yield from walk(x, f"{at}[]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict = {}
            for line in b["value"]:
                try:
                    found = walk(json.loads(line), "")
                except ValueError:
                    continue
                for x in found:
                    seen[x] = seen.get(x, 0) + 1
            yield pd.DataFrame([(p, t, n) for (p, t), n in seen.items() if p], columns=["path", "type", "n"])

    return spark.read.text(path).where("trim(value) <> ''").mapInPandas(run, "path string, type string, n bigint").groupBy("path", "type").agg(F.sum("n").alias("n"))
