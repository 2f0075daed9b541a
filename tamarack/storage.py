"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is configured a throw-away one, on a local master alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java_dir.get() if java_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tamarack-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet, with the writer's options, to the shared folder and read it back: lineage ends here.

    A lost executor costs nothing, since the files belong to no executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarack/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Materialised tables of one operation, deleted together once what it gives is written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/tamarack/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """See materialize."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class BatchTable:
    """A table on disk that grows by whole batches: each is written aside and renamed into place, so readers see all
    of it or nothing, a crash leaves no part behind, and a batch that is there already is not written again.

    A batch may hold several parts (tables) that become visible together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the batches in place, in order of their names."""
        if not self._fs.exists(self._p(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._p(self.path))]
        return sorted(n[6:] for n in names if n.startswith("batch-"))

    def append(self, batch: str, **parts: DataFrame) -> bool:
        """Writes the batch; False where it is there already."""
        target = self._p(f"{self.path}/batch-{batch}")
        if self._fs.exists(target):
            return False
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        for name, df in parts.items():
            df.write.parquet(f"{aside}/{name}")
        return bool(self._fs.rename(self._p(aside), target))

    def read(self, part: str, schema: str, batches: list[str] | None = None) -> DataFrame:
        """The rows of a part of all batches, or of the given ones; no row where there is none yet."""
        paths = [f"{self.path}/batch-{b}/{part}" for b in (self.batches() if batches is None else batches)]
        paths = [p for p in paths if self._fs.exists(self._p(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def clear(self) -> None:
        self._fs.delete(self._p(self.path), True)


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/tamarack/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan has far fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
