"""A log file as a stream: lines as they are completed, each once, by byte offsets.

An offset is the place behind the last whole line. A batch's bytes are parted into ranges; a range gives the lines that begin
in it. A file that became shorter was begun anew and is read from its start. Paths are those of pyarrow's file systems (local, hdfs://, s3://, ...).
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range, and of a look back for the last line's end.
RANGE, LOOK = 16 << 20, 64 << 10


class Span(InputPartition):
    def __init__(self, start: int, end: int, first: int):
        self.start, self.end, self.first = start, end, first


class LogSource(DataSource):
    """Option `path`; option `begin` is `start` (default) or `end`, for new lines only."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return LogReader(self.options)


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.begin = options["path"], options.get("begin", "start")

    def _open(self):  # noqa: ANN202
        fs, path = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return fs, path

    def _whole(self) -> int:
        """The place behind the last whole line."""
        fs, path = self._open()
        info = fs.get_file_info(path)
        if info.type != pafs.FileType.File:
            return 0
        with fs.open_input_file(path) as f:
            end = info.size
            while end > 0:
                start = max(0, end - LOOK)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self._whole() if self.begin == "end" else 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": self._whole()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first = start["at"] if end["at"] >= start["at"] else 0
        return [Span(k, min(end["at"], k + RANGE), first) for k in range(first, end["at"], RANGE)]

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        fs, path = self._open()
        with fs.open_input_file(path) as source, io.BufferedReader(source, LOOK) as f:
            at = partition.start
            if at > partition.first:  # the line that a range before this one began is that one's
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            else:
                f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
