"""The document catalog: snapshot differences, states, directories and path levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import globs, text
from . import bounded

# -- predicates -------------------------------------------------------------------------------


def under(path: Column, prefix: str) -> Column:
    """Paths that start with prefix; pushed to the scan."""
    return path.startswith(prefix)


def below(path: Column, directory: str) -> Column:
    """Paths within a directory, with its boundary."""
    return path.startswith(directory.rstrip("/") + "/")


def wildcard(path: Column, pattern: str) -> Column:
    return path.like(text.like_pattern(pattern if "*" in pattern else pattern + "*"))


def recent(time: Column, as_of: Column, days: int) -> Column:
    """Within the last `days` days of as_of; no days, no restriction."""
    return time.between(as_of - F.expr(f"INTERVAL '{int(days)}' DAY"), as_of) if days > 0 else F.lit(True)


def before(table: DataFrame, column: str, time: Column, status: Column | None = None) -> DataFrame:
    """Rows of a time before `time`, of a status if one is given."""
    hit = F.col(column) < time
    return table.filter(hit if status is None else hit & status)


def within(table: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Rows of a time from start to end, both included."""
    return table.filter(F.col(column).between(start, end))


def stale(directories: DataFrame, before: Column) -> DataFrame:
    return directories.filter((F.col("index_status") == "indexing") & (F.col("submit_time") < before))


# -- snapshot differences ---------------------------------------------------------------------


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listed files that the catalog lacks, ignored documents included."""
    return files.join(catalog.select("file_path"), "file_path", "left_anti")


def deleted_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(files.select("file_path"), "file_path", "left_anti")


def touched_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files modified after the catalog's update time, with changed = content hash differs."""
    old = catalog.select("file_path", F.col("md5").alias("old_md5"), F.col("update_time").alias("old_time"))
    both = files.join(old, "file_path").filter(F.col("modified") > F.col("old_time"))
    return both.withColumn("changed", ~F.col("md5").eqNullSafe(F.col("old_md5")))


def snapshot_diff(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_path, op) of one full outer join: create, delete, modify or touch; the same is left out.

    files: file_path, md5, modified; catalog: file_path, md5, update_time, state.
    """
    old = catalog.select("file_path", F.col("md5").alias("old_md5"), "update_time", F.lit(True).alias("known"))
    new = files.select("file_path", "md5", "modified", F.lit(True).alias("listed"))
    both = new.join(old, "file_path", "full")
    op = (
        F.when(F.col("known").isNull(), "create")
        .when(F.col("listed").isNull(), "delete")
        .when(F.col("modified") > F.col("update_time"), F.when(F.col("md5").eqNullSafe(F.col("old_md5")), "touch").otherwise("modify"))
    )
    return both.select("file_path", op.alias("op")).filter("op IS NOT NULL")


def apply_diff(catalog: DataFrame, files: DataFrame, diff: DataFrame, ignore: list[str]) -> DataFrame:
    """The catalog after a diff: new and modified files are saved (or ignored), deleted ones marked."""
    fresh = files.join(diff, "file_path", "left")
    state = F.when(globs.ignored(F.col("file_path"), ignore), schemas.IGNORED).otherwise(schemas.SAVED)
    written = fresh.filter("op IN ('create', 'modify')").select("file_path", "md5", F.col("modified").alias("update_time"), state.alias("state"))
    kept = catalog.join(diff, "file_path", "left").join(
        files.select("file_path", "modified"), "file_path", "left"
    )
    kept = kept.filter("op IS NULL OR op IN ('delete', 'touch')").select(
        "file_path", "md5",
        F.when(F.col("op") == "touch", F.col("modified")).otherwise(F.col("update_time")).alias("update_time"),
        F.when(F.col("op") == "delete", schemas.DELETED).otherwise(F.col("state")).alias("state"),
    )
    return kept.unionByName(written)


def reignore(catalog: DataFrame, patterns: list[str]) -> DataFrame:
    """States after a change of ignore rules: matches become ignored, ignored ones that match no more are saved."""
    hit = globs.ignored(F.col("file_path"), patterns)
    live = F.col("state").isin(schemas.SAVED, schemas.INDEXED, schemas.ERROR)
    return catalog.withColumn(
        "state", F.when(live & hit, schemas.IGNORED).when((F.col("state") == schemas.IGNORED) & ~hit, schemas.SAVED).otherwise(F.col("state"))
    )


def processed(catalog: DataFrame, outcome: DataFrame) -> DataFrame:
    """Saved documents with an outcome (file_path, error) become indexed, or error where it isn't null."""
    done = outcome.select("file_path", F.coalesce(F.col("error"), F.lit("")).alias("e"))
    both = catalog.join(done, "file_path", "left")
    moved = F.when(F.col("e") == "", schemas.INDEXED).otherwise(schemas.ERROR)
    return both.withColumn("state", F.when((F.col("state") == schemas.SAVED) & F.col("e").isNotNull(), moved).otherwise(F.col("state"))).drop("e")


def directory_states(directories: DataFrame, done: Column) -> DataFrame:
    """pending -> completed and ignore_triggered -> completed where done; deleted ones go."""
    moving = F.col("index_status").isin(schemas.PENDING, schemas.IGNORE_TRIGGERED) & done
    return directories.filter(F.col("index_status") != schemas.DELETED).withColumn("index_status", F.when(moving, schemas.COMPLETED).otherwise(F.col("index_status")))


def cascade(deleted: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each (table, document id column) without the rows of deleted documents (a column doc_id)."""
    return [t.join(deleted.select(F.col("doc_id").alias(c)), c, "left_anti") for t, c in tables]


# -- summaries --------------------------------------------------------------------------------


def directory_status(directories: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per directory: documents, indexed, failed and the completion rate.

    Each path is expanded to its ancestor directories, which join by equality; no theta join.
    """
    above = catalog.select("state", F.explode(ancestors(F.col("file_path"))).alias("directory_path"))
    counted = above.join(bounded.broadcast(directories.select("directory_path")), "directory_path").groupBy("directory_path")
    counted = counted.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == schemas.INDEXED).alias("indexed"), F.count_if(F.col("state") == schemas.ERROR).alias("failed")
    )
    out = directories.select("directory_path").join(counted, "directory_path", "left").fillna(0, ["total", "indexed", "failed"])
    return out.withColumn("rate", _rate())


def _rate() -> Column:
    return F.when(F.col("total") == 0, "0%").otherwise(F.format_string("%.1f%%", 100.0 * F.col("indexed") / F.greatest("total", F.lit(1))))


def ancestors(path: Column) -> Column:
    """The directories above a path, each ending in a slash, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))


def path_levels(paths: DataFrame, path_col: str = "file_path") -> DataFrame:
    """(level, prefix): every path cut at every level."""
    parts = F.split(F.regexp_replace(path_col, "^/", ""), "/")
    return paths.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("p", "prefix")).select(
        (F.col("p") + 1).alias("level"), "prefix"
    )


def level_counts(paths: DataFrame, path_col: str = "file_path") -> DataFrame:
    return path_levels(paths, path_col).groupBy("level").agg(F.countDistinct("prefix").alias("prefixes"))


def listed_paths(paths: DataFrame, cap: int = 5000, path_col: str = "file_path") -> DataFrame:
    """The distinct prefixes of the deepest level before the first with more than `cap` of them."""
    return picked(path_levels(paths, path_col).distinct(), cap)


def picked(cut: DataFrame, cap: int) -> DataFrame:
    """listed_paths() of distinct prefixes (level, prefix)."""
    counts = cut.groupBy("level").count()
    over = counts.agg(F.coalesce(F.min(F.when(F.col("count") > cap, F.col("level"))) - 1, F.max("level")).alias("pick"))
    return cut.join(F.broadcast(over), F.col("level") == F.greatest("pick", F.lit(1))).select("prefix")


# -- counts kept for every prefix -------------------------------------------------------------

#: Documents below each directory (with a slash at its end) and each file's own row; a table's rows are deltas, which add up.
ROLLUP = "prefix STRING, level INT, total LONG, indexed LONG, failed LONG"


def rolled_up(rows: DataFrame) -> DataFrame:
    """The deltas of each prefix, summed; those that cancel go."""
    sums = rows.groupBy("prefix", "level").agg(*(F.sum(c).alias(c) for c in ("total", "indexed", "failed")))
    return sums.filter("total <> 0 OR indexed <> 0 OR failed <> 0")


def rollup(documents: DataFrame, sign: int = 1) -> DataFrame:
    """ROLLUP rows of documents (file_path, state): added, or taken away by sign -1."""
    above = F.when(F.contains("file_path", F.lit("/")), F.concat(ancestors(F.col("file_path")), F.array("file_path"))).otherwise(F.array("file_path"))
    each = documents.select("state", F.posexplode(above).alias("level", "prefix"))
    one = lambda hit: F.when(hit, sign).otherwise(0).cast("long")
    rows = each.select("prefix", "level", one(F.lit(True)).alias("total"), one(F.col("state") == schemas.INDEXED).alias("indexed"), one(F.col("state") == schemas.ERROR).alias("failed"))
    return rolled_up(rows)


def rollup_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change of documents (file_path, state) does to the counts: as many rows as there are prefixes above them."""
    return rolled_up(rollup(before, -1).unionByName(rollup(after)))


def kept_status(directories: DataFrame, counts: DataFrame) -> DataFrame:
    """directory_status() from kept counts (ROLLUP), without reading documents."""
    held = rolled_up(counts).select(F.col("prefix").alias("directory_path"), "total", "indexed", "failed")
    out = directories.select("directory_path").join(held, "directory_path", "left").fillna(0, ["total", "indexed", "failed"])
    return out.withColumn("rate", _rate())


def kept_levels(counts: DataFrame) -> DataFrame:
    """The distinct (level, prefix) of path_levels() from kept counts."""
    held = rolled_up(counts).filter("total > 0 AND prefix <> '/'")
    # a path without a slash at its start has its first part at the place of the root
    deeper = F.when(F.col("prefix").startswith("/"), F.col("level")).otherwise(F.col("level") + 1)
    return held.select(deeper.alias("level"), F.regexp_replace("prefix", "^/|/$", "").alias("prefix")).distinct()


def sync_summary(results: DataFrame) -> DataFrame:
    """total, success and the sorted failed directories of (directory_path, ok)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("directory_path")))).alias("failed")
    )


def page(table: DataFrame, size: int, number: int = 0, order: str = "id") -> DataFrame:
    return table.orderBy(order).offset(size * number).limit(size)


def worker_page(catalog: DataFrame, worker: int, workers: int = 4, size: int = 10) -> DataFrame:
    """A worker's share of the saved documents by a hash of the name, `size` of it."""
    mine = F.conv(F.substring(F.md5("file_name"), 1, 8), 16, 10).cast("long") % workers == worker
    return catalog.filter((F.col("state") == schemas.SAVED) & mine).orderBy("id").limit(size)


# -- prefixes and routing ---------------------------------------------------------------------


def longest_prefix(paths: DataFrame, handlers: DataFrame, default: str, path_col: str = "file_path") -> DataFrame:
    """paths with the handler of the longest registered path_prefix (ending in a slash) above them."""
    above = paths.withColumn("__a", F.explode(ancestors(F.col(path_col))))
    hit = above.join(bounded.broadcast(handlers.select(F.col("path_prefix").alias("__a"), "handler")), "__a", "left")
    keys = [c for c in paths.columns]
    best = hit.groupBy(*keys).agg(F.max_by("handler", F.when(F.col("handler").isNotNull(), F.length("__a"))).alias("handler"))
    return best.withColumn("handler", F.coalesce("handler", F.lit(default)))


def plugin_of(paths: DataFrame, plugins: DataFrame, default: str) -> DataFrame:
    """The plugin whose path lies in the query's directory: the longest, ties by name; else the default.

    Plugins are listed under each directory above them, or their own path, and join by equality.
    """
    dirs = paths.withColumn("dir", F.regexp_extract("path", r"^(.*/)[^/]*$", 1))
    dirs = dirs.withColumn("dir", F.when(F.col("dir").isin("", "/"), F.col("path")).otherwise(F.col("dir")))
    starts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    under_ = plugins.select(F.explode(starts).alias("dir"), F.col("path").alias("own"), "plugin")
    first = under_.groupBy("dir").agg(F.min_by("plugin", F.struct((-F.length("own")).alias("l"), "own")).alias("plugin"))
    best = dirs.join(bounded.broadcast(first), "dir", "left").groupBy("path").agg(F.first("plugin").alias("plugin"))
    return best.withColumn("plugin", F.coalesce("plugin", F.lit(default)))


def suggest_paths(paths: DataFrame, keyword: str, files: int = 5) -> DataFrame:
    """(rank, path): directories that contain the keyword, sorted; then the first files, sorted.

    paths: seq (order of registration), path.
    """
    hit = paths.filter(F.col("path").contains(keyword.replace("\\", "/")))
    is_dir = F.col("path").endswith("/")
    kept = hit.filter(is_dir).select("path", F.lit(0).alias("kind")).distinct().unionByName(hit.filter(~is_dir).orderBy("seq").limit(files).select("path", F.lit(1).alias("kind")))
    return kept.select(F.row_number().over(Window.orderBy("kind", "path")).alias("rank"), "path")


def tasks_for_paths(changed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(file_path, task id): tasks whose directory is above a changed path, by equality on ancestors."""
    above = changed.select("file_path", F.explode(ancestors(F.col("file_path"))).alias("directory_path"))
    return above.join(tasks.select("directory_path", F.col("id").alias("task_id")), "directory_path").select("file_path", "task_id")


def tasks_above(tasks: DataFrame, path: str) -> DataFrame:
    """Tasks whose directory is a query path or above it."""
    parts = path.rstrip("/").split("/")
    above = ["/".join(parts[:k]) + "/" for k in range(1, len(parts) + 1)]
    return tasks.filter(F.col("directory_path").isin(above))


def present(directories: DataFrame, documents: DataFrame) -> DataFrame:
    """directories (path) with whether any document (file_path) lies below, by equality on the documents' ancestors."""
    asked = directories.select("path", F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/")).alias("directory_path"))
    above = documents.select(F.explode(ancestors(F.col("file_path"))).alias("directory_path"))
    held = above.join(bounded.broadcast(asked.select("directory_path")), "directory_path", "left_semi").distinct().withColumn("present", F.lit(True))
    return asked.join(held, "directory_path", "left").select("path", F.coalesce("present", F.lit(False)).alias("present"))


def exists(table: DataFrame, condition: Column) -> bool:
    return not table.filter(condition).isEmpty()


def configured(instances: DataFrame, templates: DataFrame) -> DataFrame:
    """Instances with their template's columns; an instance of an unknown template is left out."""
    return instances.join(bounded.broadcast(templates), "template_id")


def paths_by_keyword(paths: DataFrame, keyword: str, path_col: str = "file_path") -> DataFrame:
    """Paths that contain the keyword, case aside; an empty keyword finds none."""
    return paths.filter(F.lower(path_col).contains(keyword.lower()) & F.lit(bool(keyword)))


def of_documents(table: DataFrame, documents: DataFrame, prefix: str) -> DataFrame:
    """Rows of a table (doc_id) whose document lies under a prefix."""
    return table.join(documents.filter(under(F.col("file_path"), prefix)).select("doc_id"), "doc_id", "left_semi")


def deletions(files: DataFrame, normal: DataFrame, ignored: DataFrame) -> DataFrame:
    """Paths of normal and of ignored documents whose file is gone, each once."""
    return deleted_files(files, normal.select("file_path")).union(deleted_files(files, ignored.select("file_path"))).distinct()


def orphan_templates(templates: DataFrame, instances: DataFrame) -> DataFrame:
    return templates.join(instances.select("template_id").distinct(), "template_id", "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def views(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Catalog columns of a documents table (doc_id, text, lang, source): path, extension, hash, times, state."""
    ext = F.element_at(F.array(*(F.lit(x) for x in ("md", "pdf", "docx", "log", "py", "xyz"))), (F.col("doc_id") % 6 + 1).cast("int"))
    state = (
        F.when(F.col("doc_id") % 10 < 6, schemas.INDEXED).when(F.col("doc_id") % 10 == 6, schemas.SAVED).when(F.col("doc_id") % 10 == 7, schemas.ERROR)
        .when(F.col("doc_id") % 10 == 8, schemas.DELETED).otherwise(schemas.IGNORED)
    )
    path = F.concat(F.lit("/corp/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    created = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(int(doc_id % 365))")
    return docs.select("doc_id", "text", "lang", "source", path.alias("file_path"), ext.alias("ext"), F.md5("text").alias("md5"), created.alias("create_time"), state.alias("state"))
