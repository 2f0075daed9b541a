"""A mailbox over IMAP as a Spark data source; a folder of message files stands in for it elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Messages(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class ImapReader(DataSourceReader):
    """Options: host, user, password, port (993), folder (INBOX), search (ALL or UNSEEN), limit (50), mark_as_read (false),
    per_task (25), client (module.Class with the interface of imaplib.IMAP4_SSL)."""

    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}

    def connect(self):
        import importlib

        module, name = self.o.get("client", "imaplib.IMAP4_SSL").rsplit(".", 1)
        box = getattr(importlib.import_module(module), name)(self.o["host"], int(self.o.get("port", 993)))
        box.login(self.o["user"], self.o["password"])
        box.select(self.o.get("folder", "INBOX"), readonly=self.o.get("mark_as_read", "false") != "true")
        return box

    def partitions(self) -> list[InputPartition]:
        """The newest `limit` messages, newest first, in groups of per_task."""
        box = self.connect()
        _, found = box.search(None, self.o.get("search", "ALL"))
        ids = [x.decode() if isinstance(x, bytes) else x for x in (found[0] or b"").split()][-int(self.o.get("limit", 50)) :][::-1]
        box.logout()
        size = int(self.o.get("per_task", 25))
        return [Messages(ids[i : i + size]) for i in range(0, len(ids), size)] or [Messages([])]

    def read(self, partition: Messages) -> Iterator[tuple]:
        if not partition.ids:
            return
        box = self.connect()
        what = "(RFC822)" if self.o.get("mark_as_read", "false") == "true" else "(BODY.PEEK[])"
        for i in partition.ids:
            _, parts = box.fetch(i, what)
            raw = next((p[1] for p in parts if isinstance(p, tuple)), None)
            if raw is not None:
                yield (f"imap:{i}", bytes(raw))
        box.logout()


class Imap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imap"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ImapReader(self.options)


def read_imap(spark: SparkSession, **options: str):
    """(path, content) of a mailbox's newest messages; readers.parse_files makes records of them."""
    spark.dataSource.register(Imap)
    return spark.read.format("imap").options(**options).load()
