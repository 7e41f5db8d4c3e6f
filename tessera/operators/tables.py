"""Table mutation without MERGE: each operator gives the table's new rows; publish() swaps them in."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bounded


def upsert_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key: new fields override, fields that new lacks or has as null stay."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full")
    pick = lambda c: F.coalesce(*(F.col(f"{a}.{c}") for a, t in (("n", new), ("o", old)) if c in t.columns)).alias(c)
    return both.select(key, *(pick(c) for c in fields))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one with the largest order; new before old among equals."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new")))
    return rows.withColumn("__k", last).filter("__k = 1").drop("__k", "__new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def delete_prefix(table: DataFrame, path_col: str, prefix: str) -> DataFrame:
    return table.filter(~F.coalesce(F.col(path_col).startswith(prefix), F.lit(False)))


def delete_null_ids(table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table without null or 'null' ids, one row with the number removed)."""
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "null")
    return table.filter(~bad), table.agg(F.count_if(bad).alias("removed"))


def clear_field(table: DataFrame, field: str, where: Column) -> DataFrame:
    return table.withColumn(field, F.when(~F.coalesce(where, F.lit(False)), F.col(field)))


def update_where(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def append_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """(task_id, para_id, fact): facts of one paragraph and task joined by line feeds, in order of seq."""
    rows = facts.select("task_id", "para_id", F.lit(0).alias("part"), "seq", "fact").unionByName(new.select("task_id", "para_id", F.lit(1).alias("part"), "seq", "fact"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "seq", "fact")))
    return rows.groupBy("task_id", "para_id").agg(F.array_join(F.transform(ordered, lambda x: x["fact"]), "\n").alias("fact"))


def newest(table: DataFrame, order: str, keep: int = 200) -> DataFrame:
    """The newest rows, a bounded history."""
    return table.orderBy(F.desc(order)).limit(keep)


def page_back(table: DataFrame, order: str, offset: int = 0, limit: int = 5) -> DataFrame:
    """A window counted from the newest row, given in ascending order."""
    return table.orderBy(F.desc(order)).offset(offset).limit(limit).orderBy(order)


class ConcurrentCommit(RuntimeError):
    """Another writer committed since the state that a change was made from."""


def create_exclusively(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file that must not exist yet, whole or not at all; whether it was written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:  # a Java exception; only the target's existence is expected
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


@dataclass
class Change:
    """What a commit does to a table: rows whose key is in `gone` go, then `new` ones come; `everything` replaces all.

    new may be a function of the new rows, as written, of the tables that the commit names before this one. With `opened`
    it holds rows packed together, with the columns that they are dealt to files by; opened() of them, once dealt, are the table's rows.
    rows tells about how many those are, of the same tables; else they are counted.
    """

    new: DataFrame | Callable[[dict[str, DataFrame]], DataFrame] | None = None
    gone: DataFrame | None = None
    everything: bool = False
    opened: Callable[[DataFrame], DataFrame] = lambda rows: rows
    rows: Callable[[dict[str, DataFrame]], int] | None = None


@dataclass(frozen=True)
class Table:
    schema: str
    key: str
    partition: tuple[str, ...] = ()
    #: The column that rows of a bucket are dealt to files by (else they stay in the tasks that made them), and columns that files are sorted by.
    cluster: str = ""
    order: tuple[str, ...] = ()
    #: What becomes of rows when segments are merged, e.g. of those that several hold.
    merged: Callable[[DataFrame], DataFrame] = lambda rows: rows
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", [c.split()[0] for c in self.schema.split(", ")])


class Store:
    """Tables whose changes become visible together.

    A commit writes what changed (new rows, and the keys of rows that went) and then one manifest that
    names all parts of all tables. The manifest's number is taken exclusively, so of two writers one
    fails; a writer that fails before it leaves nothing that readers see. Reading unions a table's
    segments and leaves out rows whose key a later commit removed. MERGE segments of a level are merged
    into one of the next by the commit that completes them, so a row is rewritten once a level.

    A state that was superseded stays readable for `keep` seconds, which must be longer than the longest query.
    """

    MERGE = 8
    #: Rows that a task sorts and writes as one file, about: as many as fit its memory, so that the tasks grow with the rows.
    ROWS = 1_000_000
    #: A task of few rows writes several buckets' files, until it has this part of ROWS.
    SMALLER = 16

    def __init__(self, spark: SparkSession, location: str, tables: dict[str, Table], keep: float = 24 * 3600, buckets: int = 64):
        self.spark, self.location, self.tables, self.keep, self.buckets = spark, location.rstrip("/"), tables, keep, buckets

    def _fs(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.location).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.location}/manifest-*.json")) or []
        return sorted(int(x.getPath().getName()[9:-5]) for x in found)

    def _load(self, number: int) -> dict:
        fs, path = self._fs()
        source = fs.open(path(f"{self.location}/manifest-{number:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def state(self) -> tuple[int, dict]:
        """(number, {table: {"segments": [[path, number, level]], "gone": [[path, number]]}}) of the newest commit."""
        found = self._manifests()
        return (found[-1], self._load(found[-1])) if found else (-1, {})

    def read(self, name: str, state: tuple[int, dict] | None = None, only: Column | None = None) -> DataFrame:
        """The table's rows; `only` filters its segments, before anything is joined."""
        parts = (state or self.state())[1].get(name, {"segments": [], "gone": []})
        return self._rows(self.tables[name], parts["segments"], parts["gone"], only)

    def _rows(self, table: Table, segments: list, removed: list, only: Column | None = None) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], table.schema).select(table.columns)
        one = lambda path: self.spark.read.schema(table.schema).parquet(path)
        filtered = lambda df: df if only is None else df.filter(only)
        rows = reduce(DataFrame.unionByName, [filtered(one(p)).withColumn("__at", F.lit(at)) for p, at, _ in segments])
        first = min(at for _, at, _ in segments)
        gone = [self.spark.read.parquet(p) for p, at in removed if at > first]
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy(table.key).agg(F.max("__gone").alias("__gone"))
            rows = rows.join(bounded.broadcast(last), table.key, "left").filter("__gone IS NULL OR __at >= __gone")
        return rows.select(table.columns)

    def _write(self, name: str, rows: DataFrame, number: int | None = None, opened: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> str:
        """Write rows, about `number` of them once opened."""
        table, path = self.tables[name], f"{self.location}/{name}/rows-{uuid.uuid4().hex}"
        if table.cluster:
            number = rows.count() if number is None else number
            splits = max(1, -(-number // (self.ROWS * self.buckets)))
            files = self.buckets * splits
            tasks = max(1, min(files, self.SMALLER * number // self.ROWS))
            file = f"(bucket * {splits} + pmod(xxhash64({table.cluster}), {splits}))"
            rows = rows.repartitionById(tasks, F.expr(f"cast({file} * {tasks} DIV {files} AS int)"))
        rows = opened(rows)
        rows = rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in table.schema.split(", "))))
        if table.order:
            rows = rows.sortWithinPartitions(*table.partition, *table.order)
        rows.write.option("compression", "zstd").partitionBy(*table.partition).parquet(path)
        return path

    def commit(self, changes: dict[str, Change], state: tuple[int, dict] | None = None) -> int:
        """Make changes visible at once; they were made from `state`, the newest one unless given."""
        number, parts = state or self.state()
        parts = {k: {"segments": list(v["segments"]), "gone": list(v["gone"])} for k, v in parts.items()}
        at, written, made = number + 1, {}, []
        for name, change in changes.items():
            table, own = self.tables[name], parts.setdefault(name, {"segments": [], "gone": []})
            if change.everything:
                own["segments"], own["gone"] = [], []
            if change.gone is not None and own["segments"]:
                path = f"{self.location}/{name}/gone-{uuid.uuid4().hex}"
                change.gone.select(table.key).distinct().withColumn("__gone", F.lit(at)).write.parquet(path)
                own["gone"].append([path, at])
            if change.new is not None:
                number = change.rows(written) if change.rows else None
                path = self._write(name, change.new(written) if callable(change.new) else change.new, number, change.opened)
                written[name] = self.spark.read.schema(table.schema).parquet(path)
                made.append(path)
                own["segments"].append([path, at, 0])
            self._merge(name, own, at)
        if not create_exclusively(self.spark, f"{self.location}/manifest-{at:012d}.json", json.dumps(parts)):
            raise ConcurrentCommit(f"commit {at} was taken by another writer")
        named = {p for t in parts.values() for kind in t.values() for p, *_ in kind}
        fs, path = self._fs()
        for p in set(made) - named:  # merged by the commit that wrote it
            fs.delete(path(p), True)
        self._forget(at)
        return at

    def _merge(self, name: str, own: dict, at: int) -> None:
        """Merge levels that are full, and the lists of removed keys; drop those that concern no segment."""
        table, level = self.tables[name], 0
        while len(full := [x for x in own["segments"] if x[2] == level]) >= self.MERGE:
            merged = [self._write(name, table.merged(self._rows(table, full, own["gone"]))), at, level + 1]
            own["segments"] = [x for x in own["segments"] if x[2] != level] + [merged]
            level += 1
        oldest = min((x[1] for x in own["segments"]), default=at)
        own["gone"] = [x for x in own["gone"] if x[1] > oldest]
        if len(own["gone"]) >= self.MERGE:
            path = f"{self.location}/{name}/gone-{uuid.uuid4().hex}"
            gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p, _ in own["gone"]])
            gone.groupBy(table.key).agg(F.max("__gone").alias("__gone")).write.parquet(path)
            own["gone"] = [[path, max(x[1] for x in own["gone"])]]

    def _forget(self, newest: int) -> None:
        """Delete manifests that were superseded `keep` seconds ago or more, but for the last two, and the parts that only they named."""
        fs, path = self._fs()
        name = lambda n: path(f"{self.location}/manifest-{n:012d}.json")
        found = self._manifests()
        old = []
        for n, after in zip(found, found[1:]):
            # a manifest is superseded when the next one is written; later ones are younger still
            if n >= newest - 1 or time.time() - fs.getFileStatus(name(after)).getModificationTime() / 1000 < self.keep:
                break
            old.append(n)
        if not old:
            return
        named = lambda n: {p for t in self._load(n).values() for kind in t.values() for p, *_ in kind}
        alive = set().union(*(named(n) for n in found if n not in old))
        for n in old:
            for p in named(n) - alive:
                fs.delete(path(p), True)
            fs.delete(name(n), False)


class Published:
    """A table of Parquet versions: writers add a version and name it current, readers never see half of one.

    The current version is the largest number with a _SUCCESS file, which the committer writes last.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.location)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[tuple[int, str]]:
        fs, Path = self._fs()
        if not fs.exists(Path(self.location)):
            return []
        found = []
        for s in fs.listStatus(Path(self.location)):
            name = s.getPath().getName()
            if name.startswith("v") and fs.exists(Path(f"{self.location}/{name}/_SUCCESS")):
                found.append((int(name[1:].split("-")[0]), f"{self.location}/{name}"))
        return sorted(found)

    def read(self, schema: str) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(schema).parquet(found[-1][1]) if found else self.spark.createDataFrame([], schema)

    def _free(self, number: int) -> int:
        """The next number that no other writer has taken; a writer that failed leaves a gap."""
        while not create_exclusively(self.spark, f"{self.location}/taken-{number:012d}", ""):
            number += 1
        return number

    def publish(self, table: DataFrame, keep: int = 2) -> None:
        found = self.versions()
        number = found[-1][0] + 1 if found else 0
        if not create_exclusively(self.spark, f"{self.location}/taken-{number:012d}", ""):
            number = self._free(number)
        table.write.parquet(f"{self.location}/v{number:012d}-{uuid.uuid4().hex[:8]}")
        fs, Path = self._fs()
        for _, old in found[: max(0, len(found) + 1 - keep)]:
            fs.delete(Path(old), True)
