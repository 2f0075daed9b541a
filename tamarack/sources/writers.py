"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def manifest(df: DataFrame) -> DataFrame:
    return df.select("id", "label", "source", "era_bucket", "augmented", "split")


def _tagged(c: Column, t: X.DataType) -> Column:
    """JSON text of a value; what JSON has no form for becomes an object with its type."""
    tag = lambda name, v: F.to_json(F.struct(F.lit(name).alias("__type__"), v.alias("value")))
    q = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    if isinstance(t, X.DecimalType):
        out = tag("decimal", c.cast("string"))
    elif isinstance(t, X.TimestampType | X.TimestampNTZType):
        out = tag("datetime", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    elif isinstance(t, X.DateType):
        out = tag("date", c.cast("string"))
    elif isinstance(t, X.BinaryType):
        out = tag("bytes", F.base64(c))
    elif isinstance(t, X.DoubleType | X.FloatType):
        out = F.when(F.isnan(c), tag("float", F.lit("nan"))).when(F.abs(c) == float("inf"), tag("float", F.when(c > 0, "inf").otherwise("-inf"))).otherwise(q(c))
    elif isinstance(t, X.StructType):
        out = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{f.name}":'), _tagged(c[f.name], f.dataType)) for f in t.fields]), ","), F.lit("}"))
    elif isinstance(t, X.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _tagged(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, X.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(q(e["key"].cast("string")), F.lit(":"), _tagged(e["value"], t.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    else:
        out = q(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def tagged_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON that loses no decimal, time, binary or non-finite value."""
    return df.select(_tagged(F.struct(*[F.col(c) for c in df.columns]), df.schema).alias("value"))


def write_tagged(df: DataFrame, path: str) -> None:
    tagged_lines(df).write.mode("overwrite").text(path)


def url_lists(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct URLs and distinct hosts, each (value), unsorted: a writer that needs order sorts."""
    from ..functions import text as T

    urls = df.select(F.explode("urls").alias("value")).distinct()
    return urls, urls.select(T.host(F.col("value")).alias("value")).where("value <> ''").distinct()


def prometheus(metrics: DataFrame) -> DataFrame:
    """(value): `name{label="x"} n` lines of rows (name, label, n)."""
    head = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.col("name"), F.lit('{label="'), F.col("label"), F.lit('"}'))).otherwise(F.col("name"))
    return metrics.select(F.concat(head, F.lit(" "), F.col("n").cast("string")).alias("value"))


# Columns of the exported audit log.
AUDIT_COLUMNS = ["email_id", "received_at", "model_version", "subject", "predicted_label", "phishing_prob", "spam_prob", "trust_score", "routed_to_review", "analyst_label", "analyst_id", "reviewed_at", "agreement", "notes"]


def audit_export(log: DataFrame, most: int = 10_000) -> DataFrame:
    """The newest reports with the exported columns; the cap is the export's own."""
    return log.orderBy(F.desc("received_at"), F.desc("id")).limit(most).select(*AUDIT_COLUMNS)


def event_lines(df: DataFrame) -> DataFrame:
    """(value): server-sent events, one `data:` line of JSON for each row."""
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct(*df.columns)), F.lit("\n")).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines below those that are there."""
    df.write.mode("append").json(path)


def safe_name(c: Column, other: Column) -> Column:
    """A file name of the first 30 characters of a text; `other` where nothing is left of it."""
    s = F.btrim(F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, 30), "[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    return F.when(s == "", other).otherwise(s)
