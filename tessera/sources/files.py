"""File listings, format routing, and parsed files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import globs, text
from . import parsers


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Regular files below root: path (relative), extension, length, modified; content only if asked for.

    Without content the reader lists files and opens none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _literal(base) + "/*", "")
    columns = [path.alias("path"), F.lower(text.extension(path)).alias("extension"), F.col("length"), F.col("modificationTime").alias("modified")]
    return files.select(*columns, *(["content"] if content else []))


def contents(spark: SparkSession, root: str, wanted: DataFrame, by_name: int = 10_000) -> DataFrame:
    """wanted (path, extension, fmt, modified of a listing) with content; only these files are opened.

    Up to by_name files are loaded by their names; beyond it the reader skips files older than the oldest wanted.
    """
    keep = wanted.select("path", "extension", "fmt")
    names = [r["path"] for r in keep.select("path").limit(by_name + 1).collect()]
    if not names:
        return keep.withColumn("content", F.lit(None).cast("binary"))
    base = root.rstrip("/")
    if len(names) <= by_name:
        read = spark.read.format("binaryFile").load([_escaped(f"{base}/{n}") for n in names])
    else:
        oldest = wanted.agg(F.min("modified")).first()[0]
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("modificationTime") >= F.lit(oldest))
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _literal(base) + "/*", "")
    return read.select(path.alias("path"), "content").join(keep, "path")


def _escaped(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def put(spark: SparkSession, root: str, name: str, content: bytes) -> str:
    """Write a new file into a folder; its path."""
    if "/" in name or name in ("", ".", ".."):
        raise ValueError("a file name has no slashes")
    path = f"{root.rstrip('/')}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(content))
    out.close()
    return path


def _literal(s: str) -> str:
    return "\\Q" + s.removeprefix("file:") + "\\E"


def unignored(files: DataFrame, patterns: list[str], path_col: str = "path") -> DataFrame:
    return files.filter(~globs.ignored(F.col(path_col), patterns))


def format_of(extension: Column) -> Column:
    """The format that reads an extension, `other` if none."""
    names = F.create_map(*(F.lit(x) for fmt, exts in schemas.FORMATS.items() for e in exts for x in (e, fmt)))
    return F.coalesce(F.try_element_at(names, F.lower(extension)), F.lit("other"))


def enabled_formats(spark: SparkSession, settings: DataFrame | None = None) -> DataFrame:
    """(fmt, enabled): the defaults of its file type, overridden by the setting filetype.<type>.enabled."""
    rows = [(fmt, kind, schemas.ENABLED.get(kind, False)) for fmt, kind in schemas.FILE_TYPE.items()]
    base = spark.createDataFrame(rows, "fmt string, kind string, default boolean")
    if settings is None:
        return base.select("fmt", F.col("default").alias("enabled"))
    given = settings.select(
        F.regexp_extract("config_key", r"^filetype\.(\w+)\.enabled$", 1).alias("kind"), (F.lower("config_value") == "true").alias("given")
    ).filter("kind <> ''")
    return base.join(given, "kind", "left").select("fmt", F.coalesce("given", "default").alias("enabled"))


def readable(files: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """files with fmt, of the enabled formats only; the dozen formats are broadcast."""
    formats = F.broadcast(enabled_formats(files.sparkSession, settings))
    return files.withColumn("fmt", format_of(F.col("extension"))).join(formats, "fmt").filter("enabled").drop("enabled")


def parsed(files: DataFrame, ocr: parsers.Ocr | None = None) -> DataFrame:
    """(path, extension, fmt, md5, markdown, error) of files with content and fmt.

    Text-like formats are decoded by an expression; the others go through their parser.
    """
    plain = F.col("fmt").isin("text", "code", "config", "web")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    keys = ["path", "extension", "fmt", F.md5("content").alias("md5")]
    decoded = files.filter(plain).select(*keys, F.decode("content", "UTF-8").alias("body"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [parsers.parse(f, p, bytes(c or b""), ocr) for f, p, c in zip(batch["fmt"], batch["path"], batch["content"])]
            yield batch[["path", "extension", "fmt", "md5"]].assign(body=[g[0] for g in got], error=[g[1] for g in got])

    schema = "path string, extension string, fmt string, md5 string, body string, error string"
    binary = files.filter(~plain).select(*keys, "content").mapInPandas(run, schema)
    both = decoded.unionByName(binary)
    return both.select("path", "extension", "fmt", "md5", text.envelope(name, F.col("extension"), F.col("body")).alias("markdown"), "error")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line) of a log, numbered from 1 in file order.

    Lines are read split by split; a count for each split, of which the driver sees the number only,
    gives each its first line's number, so no task holds the log.
    """
    lines = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    counts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = counts.withColumn("skipped", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = lines.join(F.broadcast(before.select("part", "first", "skipped")), "part")  # a row for each split
    return joined.select((F.col("id") - F.col("first") + F.col("skipped") + 1).cast("int").alias("number"), "line")


def log_tail(lines: DataFrame, count: int = 100, known: int | None = None) -> DataFrame:
    """The last `count` lines in order, or the lines after the first `known`."""
    if known is not None:
        return lines.filter(F.col("number") > known).orderBy("number")
    return lines.orderBy(F.desc("number")).limit(count).orderBy("number")


def setting(settings: DataFrame, key: str, kind: str, default: object) -> DataFrame:
    """One row with the setting's value as `kind`: JSON-decoded or cast, the default if absent or unreadable."""
    value = F.max(F.when(F.col("config_key") == key, F.col("config_value")))
    inner = F.regexp_replace(value, '^"(.*)"$', "$1")
    typed = F.from_json(value, kind) if "<" in kind else inner.try_cast(kind)
    fallback = F.from_json(F.lit(default), kind) if "<" in kind else F.lit(default).cast(kind)
    return settings.agg(F.coalesce(typed, fallback).alias("value"))
