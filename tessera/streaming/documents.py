"""Document states as a stream: saved documents are parsed, failures are tried again by timers, each document by itself.

Events (doc_id, seq, op, file_path, modified, content) are grouped by document. A saved one is handled at once; if that fails,
a processing-time timer tries it again after `delay`, then twice that, and after `attempts` it becomes an error. A later event of the document
takes the place of what is outstanding. What is outstanding is Spark's state, so a query that is started again from its checkpoint
goes on with the retries that are due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..sources import parsers

EVENT = "doc_id LONG, seq LONG, op STRING, file_path STRING, modified TIMESTAMP, content BINARY"
OUTCOME = "doc_id LONG, file_path STRING, modified TIMESTAMP, state STRING, attempt INT, error STRING, markdown STRING"
#: (file_path, content) to Markdown; raises if the document can't be read.
Handler = Callable[[str, bytes], str]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """Handles a document's last event, and again at its timers. Emits an outcome an attempt: indexed, saved (to be tried again), error or deleted."""

    def __init__(self, handler: Handler, attempts: int = 3, delay: float = 1.0):
        self.handler, self.attempts, self.delay = handler, attempts, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "file_path string, modified timestamp, content binary, attempt int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = max((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.seq)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last.op == "delete":
            self.open.clear()
            yield self._told(key, last.file_path, last.modified, schemas.DELETED, 0)
        else:
            yield self._attempt(key, (last.file_path, last.modified, last.content, 1), timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            yield self._attempt(key, tuple(self.open.get()), timerValues)

    def close(self) -> None:
        pass

    def _attempt(self, key: Any, document: tuple, timers: Any) -> pd.DataFrame:
        path, modified, content, attempt = document
        try:
            markdown = self.handler(path, bytes(content or b""))
        except Exception as e:  # the document's failure, told in its outcome
            error = f"{type(e).__name__}: {e}"[:500]
            if attempt < self.attempts:
                self.open.update((path, modified, content, attempt + 1))
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(1000 * self.delay * attempt))
                return self._told(key, path, modified, schemas.SAVED, attempt, error)
            self.open.clear()
            return self._told(key, path, modified, schemas.ERROR, attempt, error)
        self.open.clear()
        return self._told(key, path, modified, schemas.INDEXED, attempt, None, markdown)

    @staticmethod
    def _told(key: Any, *row: Any) -> pd.DataFrame:
        columns = [c.split()[0] for c in OUTCOME.split(", ")]
        return pd.DataFrame([(key[0], *row, *[None] * (len(columns) - 1 - len(row)))], columns=columns)


def outcomes(events: DataFrame, handler: Handler, attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """A stream of OUTCOME rows of a stream of EVENT rows. The session's state store must be RocksDB (PROVIDER)."""
    return events.groupBy("doc_id").transformWithStateInPandas(Attempts(handler, attempts, delay), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime")


def parsing(path: str, content: bytes) -> str:
    """The default handler: text as it is, other formats by their parser."""
    extension = path.rpartition(".")[2].lower()
    fmt = next((f for f, own in schemas.FORMATS.items() if extension in own), "other")
    if fmt in ("text", "code", "config", "web"):
        return content.decode("utf-8")
    body, error = parsers.parse(fmt, path, content)
    if error:
        raise ValueError(error)
    return body
