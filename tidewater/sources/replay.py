"""Recorded feeds as streams: a Python data source that reads lines of files by offset.

A recording is a folder of files whose names sort in the order in which they were written,
each of JSON lines with ``received_ms``. A micro-batch is admitted by whichever comes first:
``rows`` lines, or ``span_ms`` of receive time from its first line on. An offset is a file and
a byte, so a query that is killed and started again with its checkpoint reads each line once.

Spark doesn't tell a Python source what the checkpoint has, so the last offset that was
offered is kept in the file ``progress``. After a start that offset is offered again: if the
checkpoint has it, nothing is new; if not, the batch is the same as before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "recorded_feed"
#: Bounds of one batch: lines, and milliseconds of receive time.
ROWS, SPAN_MS = 500, 1_000


@dataclass
class Stretch(InputPartition):
    """Bytes [start, end) of a file; an end below 0 is the file's."""

    file: str
    start: int
    end: int


def received_ms(line: str) -> int | None:
    """The receive time of a line; None if it has none."""
    try:
        found = json.loads(line)["received_ms"]
        return int(found)
    except (ValueError, KeyError, TypeError):
        return None


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.store, self.path = fs.FileSystem.from_uri(options["path"])
        self.progress = options["progress"]
        self.rows, self.span = int(options.get("rows", ROWS)), int(options.get("span_ms", SPAN_MS))
        self.at: dict | None = None

    def _files(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.path, recursive=True))
        return sorted(x.path for x in found if x.is_file and not x.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def _told(self) -> dict | None:
        store, path = fs.FileSystem.from_uri(self.progress)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _tell(self, offset: dict) -> None:
        store, path = fs.FileSystem.from_uri(self.progress)
        with store.open_output_stream(path + ".new") as f:
            f.write(json.dumps(offset).encode())
        store.move(path + ".new", path)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._told()
            if self.at is not None:
                return self.at
            self.at = self.initialOffset()
        self.at = self._next(self.at)
        self._tell(self.at)
        return self.at

    def _next(self, at: dict) -> dict:
        """Where a batch that begins at ``at`` ends: lines that aren't whole yet are left for later."""
        n, first = 0, None
        for file in self._files():
            if file < at["file"]:
                continue
            start = at["byte"] if file == at["file"] else 0
            for end, line in _lines(self.store, file, start, -1):
                ms = received_ms(line)
                first = ms if first is None else first
                if n == self.rows or (n and ms is not None and first is not None and ms - first >= self.span):
                    return at
                n, at = n + 1, {"file": file, "byte": end}
        return at

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.at = end if self.at is None else self.at
        out = []
        for file in self._files():
            if start["file"] <= file <= end["file"]:
                a, b = start["byte"] if file == start["file"] else 0, end["byte"] if file == end["file"] else -1
                if a != b:
                    out.append(Stretch(file, a, b))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for end, line in _lines(self.store, partition.file, partition.start, partition.end):
            yield partition.file, end, received_ms(line), line

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "at"} | {"at": None}


def _lines(store: fs.FileSystem, file: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(byte after it, text) of the whole lines in a stretch of a file."""
    with store.open_input_file(file) as f:
        f.seek(start)
        at, rest = start, b""
        while end < 0 or at + len(rest) < end:
            more = f.read(1 << 16 if end < 0 else min(1 << 16, end - at - len(rest)))
            if not more:
                return
            *whole, rest = (rest + more).split(b"\n")
            for line in whole:
                at += len(line) + 1
                yield at, line.decode("utf-8", "replace")


class RecordedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, end_byte long, received_ms long, payload string"

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(dict(self.options))


def recorded(spark: SparkSession, path: str, progress: str, rows: int = ROWS, span_ms: int = SPAN_MS) -> DataFrame:
    """A stream of a recording's lines (file, end_byte, received_ms, payload).

    ``progress``: a file of this query alone, in a folder that outlives it; start a query
    anew by giving it another one together with another checkpoint.
    """
    spark.dataSource.register(RecordedFeed)
    reader = spark.readStream.format(NAME).option("path", path).option("progress", progress)
    return reader.option("rows", rows).option("span_ms", span_ms).load()
