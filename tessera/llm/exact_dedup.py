"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of new documents is reduced to
its distinct digests (with map-side partial aggregates, so a group of copies of any size is a few
rows by the time it is shuffled), sort-merge anti-joined with the index and appended, after the batch's
decisions have been written. A document that the index holds under its own id stays, so a batch that
is run again after its result was lost, or after a lost append, is decided as before. Each append
adds a file a bucket; compact() writes a new generation of one sorted file a bucket.

Defined results: a null text counts as empty; texts are equal after lower-casing A-Z only; of equal
texts the largest doc_id stays, a null doc_id before any other; rows that repeat both doc_id and
text count in group_size, and one of them is kept. An empty table gives an empty result. Columns
beside the id and the text are carried nowhere and may have any names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT"


class DigestIndex:
    """Digests seen so far, bucketed and sorted by digest, at a location that outlives the session.

    The location holds generations; the newest complete one (that of `_SUCCESS`, or the first) is read.
    One writer appends or compacts at a time; readers may be many.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        path = spark._jvm.org.apache.hadoop.fs.Path(location)
        self.spark, self.buckets = spark, buckets
        self.location = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        self.generation = max([0, *self._complete()])
        self._open()

    def _open(self) -> None:
        """The table of the generation, created unless it exists; it must lie where this index does."""
        spark, buckets = self.spark, self.buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self._path(self.generation)}'"
        )
        lies = spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").filter("col_name = 'Location'").first().data_type
        if lies.rstrip("/").split(":", 1)[-1].lstrip("/") != self._path(self.generation).split(":", 1)[-1].lstrip("/"):
            raise ValueError(f"{self.table} lies at {lies}, not at {self._path(self.generation)}")

    def _path(self, generation: int) -> str:
        return f"{self.location}/generation-{generation:06d}"

    def _complete(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        done = path(f"{self.location}/generation-*/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        return [int(x.getPath().getParent().getName().rpartition("-")[2]) for x in found or []]

    @property
    def table(self) -> str:
        """Named by the whole location: indexes of one base name are tables of their own."""
        return f"digest_index_{hashlib.sha256(self.location.encode()).hexdigest()[:32]}_{self.generation}"

    def read(self) -> DataFrame:
        newest = max([self.generation, *self._complete()])
        if newest != self.generation:  # another session compacted
            self.generation = newest
            self._open()
        return self.spark.table(self.table)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """Digest groups that the index lacks: a sort-merge anti join on the bucketing."""
        return groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        self._sorted(groups).write.insertInto(self.table)

    def _sorted(self, groups: DataFrame) -> DataFrame:
        columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
        return groups.select(*columns).repartition(self.buckets, "digest").sortWithinPartitions("digest")

    def compact(self) -> None:
        """One sorted file a bucket, as a new generation; the one before it is kept for its readers, older ones go."""
        old, before = self.table, self.generation
        rows = self._sorted(self.read())
        self.generation += 1
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        common.delete(self.spark, self._path(self.generation))  # an incomplete one
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._path(self.generation)).saveAsTable(self.table)
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        for k in range(before):
            common.delete(self.spark, self._path(k))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        common.delete(self.spark, self.location)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row): one scan of the texts, written once; row tells repeated rows apart."""
    normal = common.lower_ascii(common.text_of(docs, text_col))
    return common.materialize(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index that has seen earlier batches, a document whose digest it holds is dropped in
    favour of the indexed keep_id, unless that is its own; group_size counts this batch's rows with
    the digest. Without one, a new index serves this batch only.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, common.scratch(spark, "digest-index"))
    each = digests(docs, id_col, text_col)
    best = F.max(F.struct("doc_id", "row"))
    groups = each.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = common.materialize(groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    fresh = common.materialize(index.fresh(groups), "fresh")
    decided = fresh
    if fresh.count() < groups.count():
        known = groups.drop("keep_id", "keep_row").hint("merge").join(index.read().select("digest", "keep_id"), "digest")
        known = common.materialize(known, "known")
        again = each.join(known.select("digest", "keep_id"), "digest").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        again = again.groupBy("digest").agg(F.max("row").alias("keep_row"))
        decided = fresh.unionByName(known.join(again, "digest", "left"))
        decided = common.materialize(decided, "decided")
    # Both sides are plain Parquet, so AQE splits the partition of a digest with very many rows.
    out = each.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    out = common.materialize(out, "exact")
    index.append(fresh)  # the decisions are written before the index knows the batch
    common.discard(each, groups, fresh, decided)
    if own:
        index.drop()
    return out


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with their own columns; of repeated rows one stays.

    Texts are shuffled only where an id repeats or is null, or where the ids to drop exceed the
    counted broadcast bound.
    """
    decided = exact_dedup(docs).select("doc_id", "kept", "text_sha256")
    odd = decided.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id")
    odd = common.materialize(odd, "exact-odd")
    named = odd.filter("doc_id IS NOT NULL")
    dropped = decided.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").union(named).distinct()
    plain = common.join_ids(docs.filter(docs["doc_id"].isNotNull()), dropped, "doc_id", "left_anti")
    if odd.isEmpty():
        return plain
    sha, of, wanted = (common.unused(docs, x) for x in ("exact_sha", "exact_of", "exact_wanted"))
    again = common.join_ids(docs, named, "doc_id", "left_semi").unionByName(docs.filter(docs["doc_id"].isNull()))
    again = again.withColumn(sha, F.sha2(common.lower_ascii(common.text_of(again)).cast("binary"), 256))
    kept = decided.filter("kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(wanted))
    same = (F.col(sha) == F.col(wanted)) & F.col("doc_id").eqNullSafe(F.col(of))
    return plain.unionByName(again.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read_table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
