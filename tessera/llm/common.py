"""Shared plumbing: the cluster's shared folder, cut lineage, size-checked joins."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["tessera"])

#: Used only where the session names no shared folder and driver and executors are one local process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tessera"
#: Id sets up to this many rows (8 bytes each) may be broadcast after counting them.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames; nothing that still is to run may read it."""
    for path in filter(None, (getattr(df, "scratch_path", None) for df in frames)):
        delete(frames[0].sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z only; every other code point stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def crc32_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on an id set; broadcast only after counting the set, else sort-merge."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def join_counted(df: DataFrame, side: DataFrame, on: str | list[str], how: str, bound: int) -> DataFrame:
    """Join with a side that is broadcast only after counting at most bound rows, else sort-merged."""
    small = side.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(side) if small else side.hint("merge"), on, how)


def once_a_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """make(), kept for later tasks of the same Python worker."""
    kept = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts and sets don't add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(512, int(spark.conf.get(key, "10000")) or 512)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
