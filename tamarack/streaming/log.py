"""The log as a stream. Arrival times may be without zone, so they become timestamps first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from ..storage import BatchTable, materialize  # noqa: F401


def mails(spark: SparkSession, folder: str) -> DataFrame:
    """New message files of a folder, parsed."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return readers.parse_files(files)


def table(spark: SparkSession, folder: str, schema: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_sightings(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once; its state ends when the watermark passes."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, label: str) -> DataFrame:
    return stream.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, time: str, late: str = "1 day", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """(start, n, overrides) of sliding windows of verdicts."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return w.groupBy(F.window(time, size, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("agreement") == 0).cast("bigint")).alias("overrides")).select(F.col("window.start").alias("start"), "n", "overrides")


def recall(stream: DataFrame, cache_path: str, sink: Callable[[DataFrame, int], None]):
    """Joins each micro-batch with the verdict cache as it is by then; returns the writer."""

    def each(batch: DataFrame, n: int) -> None:
        cache = batch.sparkSession.read.parquet(cache_path)
        sink(batch.join(cache.select(F.col("cluster_id").alias("campaign_cluster_id"), "verdict"), "campaign_cluster_id", "left"), n)

    return stream.writeStream.foreachBatch(each)


def upsert(stream: DataFrame, book, cluster=None):
    """Saves each micro-batch of reports into a ledger under its number: a replayed one changes nothing. Returns the writer."""
    return stream.writeStream.foreachBatch(lambda batch, n: book.save(f"{n:012d}", batch, cluster) and None)


def recall_into(stream: DataFrame, memory, book):
    """Each micro-batch of mails (see campaigns.recall_verdicts) with the verdicts known by then, kept as a batch of the
    table `book`; the matches are counted under the batch's number. Returns the writer."""

    def each(batch: DataFrame, n: int) -> None:
        found = materialize(memory.lookup(batch), "recalled")
        book.append(f"{n:012d}", found=found)
        memory.hit(f"{n:012d}", found.select(F.col("matched_cluster").alias("cluster_id")))

    return stream.writeStream.foreachBatch(each)


def finish(writer, checkpoint: str) -> None:
    """Runs a writer over all there is by now."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All there is by now into a memory table (tests, small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
