"""Connectors to message sources, on Spark's Python data source interface.

A connector lists its dialogs and fetches the messages of a dialog between two times. Reading deals dialogs and missing ranges of
time into partitions, so that executors fetch side by side; what fails is fetched again by Spark."""

from __future__ import annotations

import importlib
import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, doc_id string, content string, ts long, metadata string"


class Connector(ABC):
    """One source of messages; options come from the reader."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def dialogs(self) -> list[str]: ...

    @abstractmethod
    def fetch(self, dialog: str, start: int, end: int) -> Iterator[tuple[str, str, int, str]]:
        """doc_id, content, ts and metadata of the messages in [start, end)."""

    def latest(self, dialog: str) -> int:
        """The end of what there is now of a dialog: the last message's second and one more. Streams ask for it."""
        raise NotImplementedError


class Ranges(InputPartition):
    def __init__(self, dialog: str, start: int, end: int):
        self.dialog, self.start, self.end = dialog, start, end


class MessageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        module, _, name = options["connector"].rpartition(".")
        self.connector = getattr(importlib.import_module(module), name)(options)
        self.ranges = [tuple(r) for r in json.loads(options.get("ranges", "[]"))]

    def partitions(self) -> list[InputPartition]:
        known = set(self.connector.dialogs())
        return [Ranges(d, s, e) for d, s, e in self.ranges if d in known and s < e]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for doc, content, ts, metadata in self.connector.fetch(partition.dialog, partition.start, partition.end):
            yield partition.dialog, doc, content, ts, metadata


def missing(start: int, end: int, held: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that none of the ranges covers."""
    for s, e in sorted(held):
        if s > start:
            yield start, min(s, end)
        start = max(start, e)
        if start >= end:
            return
    if start < end:
        yield start, end


class MessageStreamReader(DataSourceStreamReader):
    """A stream of each dialog's messages from the time on that the ranges ask for. Offsets tell for each dialog up to where it has been
    read; of what lies between two of them only the parts that `held` (downloaded before) doesn't cover are fetched, in partitions of at
    most `step` seconds. A batch that fails is fetched again between the same offsets, so nothing comes twice."""

    def __init__(self, options: dict[str, str]):
        module, _, name = options["connector"].rpartition(".")
        self.connector = getattr(importlib.import_module(module), name)(options)
        known = set(self.connector.dialogs())
        self.ranges = {d: (s, e) for d, s, e in json.loads(options["ranges"]) if d in known}
        self.held: dict[str, list] = {}
        for d, s, e in json.loads(options.get("held", "[]")):
            self.held.setdefault(d, []).append((s, e))
        self.step = int(options.get("step", "86400"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {d: s for d, (s, _) in self.ranges.items()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {d: max(s, min(e, self.connector.latest(d))) for d, (s, e) in self.ranges.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for d in sorted(end):
            for s, e in missing(start.get(d, self.ranges[d][0]), end[d], self.held.get(d, [])):
                parts += [Ranges(d, x, min(e, x + self.step)) for x in range(s, e, self.step)]
        return parts

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for doc, content, ts, metadata in self.connector.fetch(partition.dialog, partition.start, partition.end):
            yield partition.dialog, doc, content, ts, metadata

    def commit(self, end: dict) -> None:
        pass


class MessageSource(DataSource):
    """Options: connector (the class's full name), ranges (JSON list of [dialog, start, end]); for streams also held (ranges downloaded before)
    and step."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MessageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return MessageStreamReader(dict(self.options))


def read_messages(spark: SparkSession, connector: str, ranges: list[tuple[str, int, int]], **options: str) -> DataFrame:
    spark.dataSource.register(MessageSource)
    return spark.read.format("messages").option("connector", connector).option("ranges", json.dumps(ranges)).options(**options).load()


def stream_messages(spark: SparkSession, connector: str, ranges: list[tuple[str, int, int]], held: list[tuple[str, int, int]] = [], **options: str) -> DataFrame:  # noqa: B006
    spark.dataSource.register(MessageSource)
    return spark.readStream.format("messages").option("connector", connector).option("ranges", json.dumps(ranges)).option("held", json.dumps(held)).options(**options).load()


class ParquetConnector(Connector):
    """Messages of Parquet files that all executors see. Options: path, and the names of the columns dialog, doc_id, content, ts (a timestamp
    or epoch seconds) and, if there is one, metadata."""

    def _files(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.options["path"].removeprefix("file:"), format="parquet")

    def _named(self, name: str) -> str:
        return self.options.get(name, name)

    def _seconds(self, column):
        import pyarrow as pa
        import pyarrow.compute as pc

        if pa.types.is_timestamp(column.type):
            column = pc.divide(pc.cast(column, pa.timestamp("us")).cast(pa.int64()), 1_000_000)
        return column.cast(pa.int64())

    def dialogs(self) -> list[str]:
        found: set[str] = set()
        for batch in self._files().to_batches(columns=[self._named("dialog")]):
            found |= set(batch.column(0).unique().to_pylist())
        return sorted(str(d) for d in found if d is not None)

    def latest(self, dialog: str) -> int:
        import pyarrow.compute as pc

        most = 0
        for batch in self._files().to_batches(columns=[self._named("ts")], filter=pc.field(self._named("dialog")) == dialog):
            if batch.num_rows:
                most = max(most, pc.max(self._seconds(batch.column(0))).as_py() + 1)
        return most

    def fetch(self, dialog: str, start: int, end: int) -> Iterator[tuple[str, str, int, str]]:
        import pyarrow as pa
        import pyarrow.compute as pc

        files, ts = self._files(), self._named("ts")
        kind = files.schema.field(ts).type
        at = (lambda x: pa.scalar(x * 1_000_000, pa.timestamp("us")).cast(kind)) if pa.types.is_timestamp(kind) else (lambda x: pa.scalar(x, kind))
        field = pc.field(ts)
        names = [self._named(c) for c in ("doc_id", "content", "ts")] + ([self.options["metadata"]] if "metadata" in self.options else [])
        for batch in files.to_batches(columns=names, filter=(pc.field(self._named("dialog")) == dialog) & (field >= at(start)) & (field < at(end))):
            columns = [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), self._seconds(batch.column(2)), *batch.columns[3:]]
            yield from ((*row, "{}") if len(row) == 3 else row for row in zip(*(c.to_pylist() for c in columns), strict=True))
