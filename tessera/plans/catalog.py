"""Catalog, path and table-mutation queries over a catalog derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import globs, text as tx
from ..operators import catalog, tables
from ..sources import files
from .base import C, corpus, docs, table, values, values_sql

IGNORE = ["**/src1/", "*.log", "/corp/src2/de/", "7*.md"]
HANDLERS = [("/corp/", "root"), ("/corp/src1/", "one"), ("/corp/src1/en/", "english"), ("/corp/src11/", "eleven")]
DIRS = [("/corp/src0/",), ("/corp/src1/en/",), ("/corp/src12/de/",), ("/corp/none/",)]
TASKS = [(1, "/corp/src0/"), (2, "/corp/src1/en/"), (3, "/corp/"), (4, "/corp/src1/enx/")]
WILD = "/corp/src1*/en/*_*"


def _days(expr: str) -> str:
    return f"timestamp'2024-06-01 00:00:00' + make_dt_interval(int({expr}))"


def _old(c: DataFrame) -> DataFrame:
    return c.filter("source <> 'src7'").select("file_path", "md5", F.expr(_days("0")).alias("update_time"), "state")


def _new(c: DataFrame) -> DataFrame:
    md5 = F.when(F.col("doc_id") % 2 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.col("md5"))
    return c.filter("source <> 'src5'").select("file_path", md5.alias("md5"), F.expr(_days("IF(doc_id % 3 = 0, 1, 0)")).alias("modified"))


OLD_NEW = f"""{C}, o AS (SELECT file_path, md5, 0 AS t, state FROM c WHERE source <> 'src7'),
n AS (SELECT file_path, CASE WHEN doc_id % 2 = 0 THEN md5(text || '!') ELSE md5 END AS md5, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS t FROM c WHERE source <> 'src5')"""


def ext_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("doc_id", tx.extension(F.col("file_path")).alias("extension"))
    return c.withColumn("fmt", files.format_of(F.col("extension")))


_FMT = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(e) for e in exts)}) THEN '{f}'" for f, exts in schemas.FORMATS.items()) + " ELSE 'other' END"
EXT_SQL = f"WITH {C}, x AS (SELECT doc_id, regexp_extract(file_path, '\\.([^.]*)$', 1) AS extension FROM c) SELECT doc_id, extension, {_FMT.format('lower(extension)')} AS fmt FROM x"


def enabled_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = values(spark, [("filetype.pdf.enabled", "false"), ("filetype.other.enabled", "true")], "config_key string, config_value string")
    rows = corpus(spark, sf_dir).select("doc_id", F.col("ext").alias("extension"))
    return files.readable(rows, settings).groupBy("fmt").agg(F.count(F.lit(1)).alias("files"))


_ON = "', '".join(f for f, k in schemas.FILE_TYPE.items() if k == "other" or schemas.ENABLED[k] and k != "pdf")
ENABLED_SQL = f"WITH {C} SELECT {_FMT.format('ext')} AS fmt, count(*) AS files FROM c WHERE {_FMT.format('ext')} IN ('{_ON}') GROUP BY 1"


def ignore_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", globs.ignored(F.col("file_path"), IGNORE).alias("ignored"))


IGNORE_SQL = f"WITH {C} SELECT doc_id, regexp_matches(ltrim(file_path, '/'), '{globs.ignore_regex(IGNORE)}') AS ignored FROM c"


def doc_md5_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return c.groupBy("md5").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return catalog.snapshot_diff(_new(c), _old(c))


DIFF_SQL = f"""WITH {OLD_NEW}, b AS (SELECT coalesce(n.file_path, o.file_path) AS file_path,
CASE WHEN o.file_path IS NULL THEN 'create' WHEN n.file_path IS NULL THEN 'delete' WHEN n.t > o.t THEN CASE WHEN n.md5 = o.md5 THEN 'touch' ELSE 'modify' END END AS op
FROM n FULL JOIN o ON n.file_path = o.file_path) SELECT * FROM b WHERE op IS NOT NULL"""


def catalog_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return catalog.new_files(_new(c).select("file_path"), _old(c))


def catalog_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return catalog.deleted_files(_new(c), _old(c).select("file_path", "state"))


def catalog_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return catalog.touched_files(_new(c), _old(c)).select("file_path", "changed")


def catalog_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    new, old = _new(c), _old(c)
    return catalog.apply_diff(old, new, catalog.snapshot_diff(new, old), IGNORE).select("file_path", "md5", "state")


APPLIED_SQL = f"""WITH {OLD_NEW}, b AS (SELECT coalesce(n.file_path, o.file_path) AS file_path, n.md5 AS nm, o.md5 AS om, o.state,
CASE WHEN o.file_path IS NULL THEN 'create' WHEN n.file_path IS NULL THEN 'delete' WHEN n.t > o.t THEN CASE WHEN n.md5 = o.md5 THEN 'touch' ELSE 'modify' END END AS op
FROM n FULL JOIN o ON n.file_path = o.file_path)
SELECT file_path, CASE WHEN op IN ('create', 'modify') THEN nm ELSE om END AS md5,
CASE WHEN op = 'delete' THEN '{schemas.DELETED}' WHEN op IN ('create', 'modify') THEN CASE WHEN regexp_matches(ltrim(file_path, '/'), '{globs.ignore_regex(IGNORE)}') THEN '{schemas.IGNORED}' ELSE '{schemas.SAVED}' END ELSE state END AS state FROM b"""


def ignore_reapplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reignore(corpus(spark, sf_dir).select("doc_id", "file_path", "state"), IGNORE).select("doc_id", "state")


REIGNORE_SQL = f"""WITH {C}, x AS (SELECT doc_id, state, regexp_matches(ltrim(file_path, '/'), '{globs.ignore_regex(IGNORE)}') AS hit FROM c)
SELECT doc_id, CASE WHEN hit AND state IN ('{schemas.SAVED}', '{schemas.INDEXED}', '{schemas.ERROR}') THEN '{schemas.IGNORED}' WHEN NOT hit AND state = '{schemas.IGNORED}' THEN '{schemas.SAVED}' ELSE state END AS state FROM x"""


def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("doc_id", "lang", "file_path", "state")
    outcome = c.filter("lang <> 'es'").select("file_path", F.when(F.col("lang") == "de", "unreadable").alias("error"))
    return catalog.processed(c, outcome).groupBy("state").agg(F.count(F.lit(1)).alias("documents"))


STATES_SQL = f"""WITH {C} SELECT CASE WHEN state = '{schemas.SAVED}' AND lang <> 'es' THEN CASE WHEN lang = 'de' THEN '{schemas.ERROR}' ELSE '{schemas.INDEXED}' END ELSE state END AS state, count(*) AS documents FROM c GROUP BY 1"""


def dir_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.directory_status(values(spark, DIRS, "directory_path string"), corpus(spark, sf_dir))


DIR_SQL = f"""WITH {C} SELECT directory_path, count(doc_id) AS total, count(*) FILTER (state = '{schemas.INDEXED}') AS indexed, count(*) FILTER (state = '{schemas.ERROR}') AS failed,
CASE WHEN count(doc_id) = 0 THEN '0%' ELSE printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (state = '{schemas.INDEXED}') / count(doc_id)) END AS rate
FROM {values_sql(DIRS, 'directory_path')} LEFT JOIN c ON starts_with(file_path, directory_path) GROUP BY 1"""


def path_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.level_counts(corpus(spark, sf_dir))


LEVELS = f"{C}, p AS (SELECT string_split(ltrim(file_path, '/'), '/') AS x FROM c), l AS (SELECT DISTINCT k AS level, array_to_string(x[:k], '/') AS prefix FROM (SELECT x, unnest(range(1, len(x) + 1)) AS k FROM p))"
LEVEL_SQL = f"WITH {LEVELS} SELECT level::INT AS level, count(*) AS prefixes FROM l GROUP BY level"


def path_level_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listed_paths(corpus(spark, sf_dir), cap=50)


PICK_SQL = f"""WITH {LEVELS}, n AS (SELECT level, count(*) AS c FROM l GROUP BY 1), w AS (SELECT greatest(coalesce(min(CASE WHEN c > 50 THEN level END) - 1, max(level)), 1) AS pick FROM n)
SELECT prefix FROM l, w WHERE level = pick"""


def longest_prefix_handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.longest_prefix(corpus(spark, sf_dir).select("doc_id", "file_path"), values(spark, HANDLERS[1:], "path_prefix string, handler string"), "default").select("doc_id", "handler")


PREFIX_SQL = f"""WITH {C}, h AS (SELECT doc_id, handler, row_number() OVER (PARTITION BY doc_id ORDER BY length(path_prefix) DESC NULLS LAST) AS k
FROM c LEFT JOIN {values_sql(HANDLERS[1:], 'path_prefix, handler')} ON starts_with(file_path, path_prefix)) SELECT doc_id, coalesce(handler, 'default') AS handler FROM h WHERE k = 1"""

PLUGINS = [("/corp/src1/en/a", "p1"), ("/corp/src1/en/bb", "p2"), ("/corp/src12/x", "p3"), ("/corp/src12/y", "p4")]


def plugin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.plugin_of(corpus(spark, sf_dir).select(F.col("file_path").alias("path")), values(spark, PLUGINS, "path string, plugin string"), "default")


PLUGIN_SQL = f"""WITH {C}, q AS (SELECT file_path AS path, regexp_extract(file_path, '^(.*/)[^/]*$', 1) AS dir FROM c),
h AS (SELECT q.path, plugin, row_number() OVER (PARTITION BY q.path ORDER BY length(own) DESC NULLS LAST, own) AS k FROM q LEFT JOIN (SELECT * FROM {values_sql(PLUGINS, 'own, plugin')}) p ON starts_with(own, dir))
SELECT path, coalesce(plugin, 'default') AS plugin FROM h WHERE k = 1"""


def path_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    dirs = c.select(F.concat(F.lit("/corp/"), "source", F.lit("/")).alias("path")).distinct().withColumn("seq", F.lit(0).cast("long"))
    return catalog.suggest_paths(dirs.unionByName(c.select(F.col("file_path").alias("path"), (F.col("doc_id") + 1).alias("seq"))), "/src1")


SUGGEST_SQL = f"""WITH {C}, p AS (SELECT DISTINCT '/corp/' || source || '/' AS path, 0 AS seq, 0 AS kind FROM c UNION ALL SELECT file_path, doc_id + 1, 1 FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS n FROM p WHERE contains(path, '/src1'))
SELECT row_number() OVER (ORDER BY kind, path)::INT AS rank, path FROM h WHERE kind = 0 OR n <= 5"""


def tasks_for_changed_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tasks_for_paths(corpus(spark, sf_dir), values(spark, TASKS, "id long, directory_path string"))


TASKS_SQL = f"WITH {C} SELECT file_path, id::BIGINT AS task_id FROM c JOIN {values_sql(TASKS, 'id, directory_path')} ON starts_with(file_path, directory_path)"


def wildcard_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("doc_id", F.concat("file_path", F.when(F.col("doc_id") % 2 == 0, "_v").otherwise("-v")).alias("file_path"))
    return c.filter(catalog.wildcard(F.col("file_path"), WILD))


WILD_SQL = f"WITH {C}, x AS (SELECT doc_id, file_path || CASE WHEN doc_id % 2 = 0 THEN '_v' ELSE '-v' END AS file_path FROM c) SELECT * FROM x WHERE file_path LIKE '/corp/src1%/en/%^_%' ESCAPE '^'"


def prefix_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    hit = c.filter(catalog.under(F.col("file_path"), "/corp/src1/") & F.col("state").isin(schemas.INDEXED, schemas.SAVED))
    return hit.filter(catalog.recent(F.col("create_time"), F.to_timestamp(F.lit("2024-12-31")), 300)).select("doc_id", "state")


STATE_SQL = f"WITH {C} SELECT doc_id, state FROM c WHERE starts_with(file_path, '/corp/src1/') AND state IN ('{schemas.INDEXED}', '{schemas.SAVED}') AND create_time BETWEEN TIMESTAMP '2024-12-31' - to_days(300) AND TIMESTAMP '2024-12-31'"


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    odd = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/local/D:\\"), F.regexp_replace("file_path", "/", "\\\\"))).otherwise(F.concat(F.lit("/local"), "file_path"))
    return c.select("doc_id", tx.parent_path(F.col("file_path")).alias("parent"), tx.normal_prefix(odd).alias("prefix"), tx.valid_text(F.col("text"), 100).alias("valid"))


PATH_SQL = f"""WITH {C}, x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '/local/D:\\' || replace(file_path, '/', '\\') ELSE '/local' || file_path END AS odd FROM c)
SELECT doc_id, regexp_extract(file_path, '^(.+)[/\\\\:][^/\\\\:]*$', 1) AS parent,
regexp_replace(replace(regexp_replace(regexp_replace(odd, '^/local(/|$)', '\\1'), '^/([A-Za-z]:)', '\\1'), '\\', '/'), '//+', '/', 'g') AS prefix,
length(regexp_replace(text, '\\s+', '', 'g')) > 100 AS valid FROM x"""


def index_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    old = c.filter("source <> 'src3'").select("doc_id", "lang", F.col("source").alias("origin"))
    new = c.filter("lang <> 'en'").select("doc_id", F.when(F.col("lang") == "fr", "xx").alias("lang"), F.lit(True).alias("fresh"))
    return tables.upsert_merge(old, new, "doc_id")


MERGE_SQL = """WITH o AS (SELECT doc_id, lang, source AS origin FROM documents WHERE source <> 'src3'), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'xx' END AS lang, true AS fresh FROM documents WHERE lang <> 'en')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.lang, o.lang) AS lang, origin, fresh FROM o FULL JOIN n ON o.doc_id = n.doc_id"""


def config_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("source").alias("config_key"), F.col("lang").alias("config_value"), F.col("doc_id").alias("at"))
    return tables.upsert_latest(d.filter("config_value = 'en'"), d.filter("config_value <> 'en'"), "config_key", "at")


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("source", "lang").distinct()
    return tables.insert_absent(d.filter("lang <> 'en'"), d.filter("lang IN ('en', 'de')"), ["source", "lang"])


def index_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after deleting ids, a path prefix, and null ids in turn."""
    c = corpus(spark, sf_dir).select("doc_id", "file_path", "state", F.when(F.col("state") != schemas.IGNORED, F.col("doc_id")).alias("para_id"))
    left = tables.delete_ids(c, c.filter(F.col("state") == schemas.DELETED), "doc_id")
    return tables.delete_null_ids(tables.delete_prefix(left, "file_path", "/corp/src3/"), "para_id")[0].select("doc_id")


DELETES_SQL = f"WITH {C} SELECT doc_id FROM c WHERE state NOT IN ('{schemas.DELETED}', '{schemas.IGNORED}') AND NOT starts_with(file_path, '/corp/src3/')"


def field_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("doc_id", "lang", "file_path", "state", F.lit("t1").alias("task"))
    c = tables.clear_field(c, "task", F.col("lang") == "fr")
    return tables.update_where(c, catalog.under(F.col("file_path"), "/corp/src2/"), state=F.lit(schemas.DELETED)).select("doc_id", "state", "task")


FIELD_SQL = f"WITH {C} SELECT doc_id, CASE WHEN starts_with(file_path, '/corp/src2/') THEN '{schemas.DELETED}' ELSE state END AS state, CASE WHEN lang <> 'fr' THEN 't1' END AS task FROM c"


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    facts = table(spark, sf_dir, "labels").select("doc_id", "quality")
    left, labels = catalog.cascade(c.filter(F.col("state") == schemas.DELETED), (c.select("doc_id"), "doc_id"), (facts, "doc_id"))
    return left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("table"), "n").unionByName(labels.agg(F.count(F.lit(1)).alias("n")).select(F.lit("labels").alias("table"), "n"))


CASCADE_SQL = """SELECT 'documents' AS "table", count(*) AS n FROM documents WHERE doc_id % 10 <> 8 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 8)"""


def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(corpus(spark, sf_dir).filter(F.col("state") == schemas.SAVED).select("doc_id", "file_path"), 10, 2, "doc_id")


def directory_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ["pending", "completed", "deleted", "ignore_triggered"]
    d = docs(spark, sf_dir).select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("directory_path"), F.element_at(F.array(*map(F.lit, states)), (F.col("doc_id") % 4 + 1).cast("int")).alias("index_status"), (F.col("doc_id") % 3 == 0).alias("done"))
    return catalog.directory_states(d, F.col("done")).groupBy("index_status").agg(F.count(F.lit(1)).alias("directories"))


DIRECTORY_SQL = """WITH d AS (SELECT ['pending', 'completed', 'deleted', 'ignore_triggered'][doc_id % 4 + 1] AS s, doc_id % 3 = 0 AS done FROM documents)
SELECT CASE WHEN done AND s IN ('pending', 'ignore_triggered') THEN 'completed' ELSE s END AS index_status, count(*) AS directories FROM d WHERE s <> 'deleted' GROUP BY 1"""


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("directory_path"), (F.col("doc_id") % 9 != 0).alias("ok"))
    return catalog.sync_summary(d).select("total", "success", F.array_join("failed", ",").alias("failed"))


QUERIES = {
    "ext_routing": (ext_routing, EXT_SQL),
    "enabled_filter": (enabled_filter, ENABLED_SQL),
    "ignore_glob": (ignore_glob, IGNORE_SQL),
    "doc_md5_dups": (doc_md5_dups, "SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "catalog_diff": (catalog_diff, DIFF_SQL),
    "catalog_new": (catalog_new, f"WITH {OLD_NEW} SELECT file_path FROM n WHERE file_path NOT IN (SELECT file_path FROM o)"),
    "catalog_deleted": (catalog_deleted, f"WITH {OLD_NEW} SELECT file_path, state FROM o WHERE file_path NOT IN (SELECT file_path FROM n)"),
    "catalog_updated": (catalog_updated, f"WITH {OLD_NEW} SELECT file_path, n.md5 <> o.md5 AS changed FROM n JOIN o USING (file_path) WHERE n.t > o.t"),
    "catalog_applied": (catalog_applied, APPLIED_SQL),
    "ignore_reapplied": (ignore_reapplied, REIGNORE_SQL),
    "document_states": (document_states, STATES_SQL),
    "dir_status": (dir_status, DIR_SQL),
    "path_level_counts": (path_level_counts, LEVEL_SQL),
    "path_level_pick": (path_level_pick, PICK_SQL),
    "longest_prefix_handler": (longest_prefix_handler, PREFIX_SQL),
    "plugin_lookup": (plugin_lookup, PLUGIN_SQL),
    "path_suggestions": (path_suggestions, SUGGEST_SQL),
    "tasks_for_changed_doc": (tasks_for_changed_doc, TASKS_SQL),
    "wildcard_docs": (wildcard_docs, WILD_SQL),
    "prefix_state_filter": (prefix_state_filter, STATE_SQL),
    "path_functions": (path_functions, PATH_SQL),
    "index_upsert_merge": (index_upsert_merge, MERGE_SQL),
    "config_upsert_latest": (config_upsert_latest, "SELECT source AS config_key, arg_max(lang, doc_id) AS config_value, max(doc_id) AS \"at\" FROM documents GROUP BY 1"),
    "insert_absent": (insert_absent, "SELECT DISTINCT source, lang FROM documents"),
    "index_deletes": (index_deletes, DELETES_SQL),
    "field_update": (field_update, FIELD_SQL),
    "cascade_delete": (cascade_delete, CASCADE_SQL),
    "catalog_page": (catalog_page, f"WITH {C} SELECT doc_id, file_path FROM c WHERE state = '{schemas.SAVED}' ORDER BY doc_id LIMIT 10 OFFSET 20"),
    "directory_states": (directory_states, DIRECTORY_SQL),
    "sync_summary": (sync_summary, "SELECT count(*) AS total, count(*) FILTER (doc_id % 9 <> 0) AS success, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FILTER (doc_id % 9 = 0) AS failed FROM documents"),
}
