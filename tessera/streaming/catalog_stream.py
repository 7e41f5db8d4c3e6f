"""The catalog and its index kept up to date by micro-batches of file events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import globs
from ..operators import index, search
from ..operators.tables import Change, Store, Table

EVENT = "seq LONG, op STRING, doc_id LONG, file_path STRING, md5 STRING, modified TIMESTAMP, text STRING"
CATALOG = "doc_id LONG, file_path STRING, md5 STRING, update_time TIMESTAMP, state STRING, text STRING, batch LONG"


def settled(events: DataFrame, batch: int, ignore: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to write, paths that change) of events: the last event of each path decides."""
    last = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("seq")))
    final = events.withColumn("__k", last).filter("__k = 1")
    state = F.when(globs.ignored(F.col("file_path"), ignore), schemas.IGNORED).otherwise(schemas.INDEXED)
    written = final.filter("op <> 'delete'").select("doc_id", "file_path", "md5", F.col("modified").alias("update_time"), state.alias("state"), "text", F.lit(batch).cast("long").alias("batch"))
    return written, final.select("file_path")


class CatalogStream:
    """foreachBatch maintenance of a catalog and its index: a micro-batch writes what its paths change, visible by one commit.

    A batch that is replayed replaces the same paths by the same rows, so it changes nothing.
    """

    def __init__(self, spark: SparkSession, location: str, ignore: list[str] | None = None, analyzer: search.Analyzer = search.LATIN, buckets: int = index.BUCKETS):
        self.spark = spark
        self.location = location.rstrip("/")
        self.ignore = schemas.IGNORED_BY_DEFAULT if ignore is None else ignore
        self.store = Store(spark, f"{self.location}/tables", {"catalog": Table(CATALOG, "file_path"), **index.TABLES}, buckets=buckets)
        self.index = index.TextIndex(spark, self.location, buckets, self.store, analyzer)

    def read(self) -> DataFrame:
        return self.store.read("catalog")

    def postings(self) -> DataFrame:
        return self.index.postings()

    def _batch(self, events: DataFrame, number: int) -> None:
        state = self.store.state()
        events.persist()
        try:
            new, paths = settled(events, number, self.ignore)
            old = self.store.read("catalog", state).join(paths, "file_path", "left_semi").select("doc_id")
            gone = old.union(new.select("doc_id")).distinct()
            searchable = new.filter(F.col("state") == schemas.INDEXED)
            self.store.commit({"catalog": Change(new, paths), **self.index.changes(searchable, gone)}, state)
        finally:
            events.unpersist()

    def start(self, events: DataFrame, available_now: bool = True, period: str = "5 seconds") -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.location}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=period)).start()


def file_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files (JSON lines) that appear in a folder."""
    return spark.readStream.schema(EVENT).json(path)
