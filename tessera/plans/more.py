"""Further lookups, joins, settings and result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import plugins, schemas
from ..engine import Engine
from ..functions import globs
from ..functions import text as tx
from ..operators import catalog, chunk, facts, search, similar
from ..operators.tables import Change
from ..sources import files, web
from .base import C, corpus, docs, rounded, scratch, table, tokens_sql, values, values_sql
from .facts import BATCH_SQL, FACTS, facts_extract
from .search import counted_sql, score_sql

TEMPLATES = [("src0", "a"), ("src1", "b"), ("src2", "c"), ("unused", "d")]
ASKED = [30, 999999999, 4, 17]


def prefix_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.of_documents(table(spark, sf_dir, "labels").select("doc_id", "quality"), corpus(spark, sf_dir), "/corp/src1")


def configured_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = docs(spark, sf_dir).select(F.col("source").alias("template_id"), "lang").distinct()
    return catalog.configured(instances, values(spark, TEMPLATES, "template_id string, body string"))


def orphan_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = docs(spark, sf_dir).select(F.col("source").alias("template_id"))
    return catalog.orphan_templates(values(spark, TEMPLATES, "template_id string, body string"), instances)


def keyword_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.paths_by_keyword(corpus(spark, sf_dir).select("file_path"), "SRC1/En")


def gone_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("file_path", "state", "lang")
    ignored = F.col("state") == schemas.IGNORED
    return catalog.deletions(c.filter("lang <> 'fr'").select("file_path"), c.filter(~ignored), c.filter(ignored))


def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    rows = p.select(
        F.col("page_id").alias("position"), web.page_title(F.col("html")).alias("title"), web.host(F.col("url")).alias("url"), (F.col("page_id") % 10 == 0).alias("is_ad")
    )
    return web.results(rows).drop("is_ad")


WEB_SQL = """WITH r AS (SELECT page_id AS position, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS url FROM pages WHERE page_id % 10 <> 0)
SELECT position, title, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) AS k FROM r WHERE title IS NOT NULL AND url IS NOT NULL) WHERE k = 1"""


def valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = corpus(spark, sf_dir).select(F.col("doc_id").alias("para_id"), F.when(F.col("lang") != "de", F.col("file_path")).alias("url"))
    return facts.valid(facts_extract(spark, sf_dir).join(paths, "para_id"))


def single_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return facts.single_batches(lines.select("doc_id", "ord"), "doc_id", "ord")


def unfinished_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.unfinished(docs(spark, sf_dir).select(F.col("doc_id").alias("para_id"), "lang"), 500)


def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read as a number, a quoted text, a number that isn't one, a flag, and one that is absent."""
    d = docs(spark, sf_dir)
    s = d.groupBy(F.col("source").alias("config_key")).agg(F.max("doc_id").cast("string").alias("config_value"))
    s = s.unionByName(d.select(F.col("lang").alias("config_key"), F.concat(F.lit('"'), "lang", F.lit('"')).alias("config_value")).distinct())
    s = s.unionByName(d.groupBy(F.concat("source", F.lit(".on")).alias("config_key")).agg((F.count(F.lit(1)) > 0).cast("string").alias("config_value")))
    one = lambda key, kind, default: files.setting(s, key, kind, default).select(F.lit(key).alias("config_key"), F.col("value").cast("string").alias("value"))
    return catalog.union_all([one("src1", "int", 1), one("en", "string", ""), one("de", "int", 7), one("src1.on", "boolean", False), one("none", "int", 8)])


SETTINGS_SQL = """SELECT 'src1' AS config_key, coalesce(max(doc_id)::VARCHAR, '1') AS value FROM documents WHERE source = 'src1'
UNION ALL SELECT 'en', coalesce(max(lang), '') FROM documents WHERE lang = 'en' UNION ALL SELECT 'de', '7'
UNION ALL SELECT 'src1.on', (count(*) > 0)::VARCHAR FROM documents WHERE source = 'src1' UNION ALL SELECT 'none', '8'"""


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose catalog, paragraphs (one a document) and index are the documents table."""
    c = corpus(spark, sf_dir)
    own = Engine(spark, scratch(spark, "engine"), analyzer=search.LATIN, buckets=8)
    para = c.select(F.col("doc_id").alias("para_id"), "doc_id", F.lit(0).alias("ord"), F.col("text").alias("content"), own.bucket().alias("bucket"))
    own.store.commit({
        "documents": Change(c.withColumn("update_time", F.col("create_time"))),
        "directories": Change(catalog.rollup(c)),
        "paragraphs": Change(para),
        **own.index.changes(para, None, "para_id", "content"),
    })
    return own


def fetched_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).fetch_content(ASKED)


def simple_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two terms under a prefix, ranked, in tags, or the first 150 characters."""
    return rounded(_engine(spark, sf_dir).simple_search("released rights", "/corp/src1", 40), "score")


SIMPLE_SQL = rf"""WITH {C}, {counted_sql(['released', 'rights'], 'c', ', file_path, state, text')},
h AS (SELECT doc_id, file_path, text, 1 + {score_sql([0, 1])} AS score FROM s, g WHERE (tf0 > 0 OR tf1 > 0) AND starts_with(file_path, '/corp/src1') AND state = '{schemas.INDEXED}'),
d AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM h ORDER BY h.score DESC, doc_id LIMIT 40),
k AS (SELECT doc_id, text, k, substr(text, k * 300 + 1, 300) AS f FROM (SELECT *, unnest(range(0, ceil(greatest(length(text), 1) / 300)::INT)) AS k FROM d)),
x AS (SELECT *, len(regexp_extract_all(f, '(?i)\b(released|rights)\b')) AS hits FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, k) AS n FROM x)
SELECT rank, doc_id AS para_id, round(score, 6) AS score, CASE WHEN hits > 0 THEN regexp_replace(f, '(?i)\b(released|rights)\b', '<em>\1</em>', 'g') ELSE substr(b.text, 1, 150) END AS snippet, file_path
FROM b JOIN d USING (doc_id) WHERE n = 1"""


TASK = ("/corp/src1/", "all rights reserved")


def task_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standing task kept up to date: extracted, French documents changed, Spanish ones deleted, answered from twice."""
    own = _engine(spark, sf_dir)
    own.create_task(*TASK)
    own.refresh_tasks()
    own.put(corpus(spark, sf_dir).filter(_CHANGED).select("file_path", F.concat("text", F.lit(" All rights reserved again.")).alias("markdown"), F.expr("create_time + INTERVAL 1 DAY").alias("modified")))
    own.delete(F.col("file_path").contains("/es/"))
    for _ in range(2):
        own.collect_facts(TASK[1], TASK[0])
    columns = ["directory_path", "status", "covered_file_count", "facts", "full_cost", "incremental_cost", "hit_count"]
    return own.progress().select(*columns)


_CHANGED = f"lang = 'fr' AND state = '{schemas.INDEXED}' AND length(text) < 4900"
_HAS = f"len(list_intersect(['all', 'reserved', 'rights'], {tokens_sql('fact')})) / 3::DOUBLE >= {facts.OVERLAP}"
_FACTS_OF = "list_filter(list_filter(list_transform(regexp_extract_all(content, '[^.!?\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> ''), lambda fact: " + _HAS + ")"
TASK_SQL = f"""WITH {C}, d AS (SELECT doc_id, lang, text, {_CHANGED} AS changed FROM c WHERE state = '{schemas.INDEXED}' AND starts_with(file_path, '{TASK[0]}')),
b AS (SELECT *, {_FACTS_OF} AS fs FROM (SELECT *, text AS content FROM d)),
a AS (SELECT *, {_FACTS_OF} AS fs FROM (SELECT *, text || ' All rights reserved again.' AS content FROM d WHERE changed)),
cost AS (SELECT 0 AS k, length(content) + {len(TASK[1])} + coalesce(list_sum(list_transform(fs, lambda x: length(x))), 0) AS n FROM b
  UNION ALL SELECT 1, length(content) + {len(TASK[1])} + coalesce(list_sum(list_transform(fs, lambda x: length(x))), 0) FROM a)
SELECT '{TASK[0]}' AS directory_path, 'active' AS status, (SELECT count(*) FROM d WHERE lang <> 'es')::INT AS covered_file_count,
  ((SELECT coalesce(sum(len(fs)), 0) FROM b WHERE lang <> 'es' AND NOT changed) + (SELECT coalesce(sum(len(fs)), 0) FROM a))::BIGINT AS facts,
  (SELECT sum(n) FROM cost WHERE k = 0)::BIGINT AS full_cost, coalesce((SELECT sum(n) FROM cost WHERE k = 1), 0)::BIGINT AS incremental_cost, 2 AS hit_count"""


DIRECTORIES = ["/corp/", "/corp/src1/", "/corp/src2/es/", "/corp/src0/fr/", "/none/"]


def _changed(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose Spanish documents of three digits went and whose German ones were changed."""
    own = _engine(spark, sf_dir)
    own.delete(F.col("file_path").rlike(r"/es/\d{3}\."))
    own.put(corpus(spark, sf_dir).filter("lang = 'de' AND length(text) < 2000").select("file_path", F.concat("text", F.lit(" more")).alias("markdown"), F.expr("create_time + INTERVAL 1 DAY").alias("modified")))
    return own


def kept_directory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory counts kept by deltas over a deletion and a change."""
    return _changed(spark, sf_dir).directory_status(DIRECTORIES)


def kept_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).path_levels()


_NOW = f"""WITH {C}, d AS (SELECT doc_id, file_path, CASE WHEN lang = 'de' AND length(text) < 2000 THEN '{schemas.INDEXED}' ELSE state END AS state FROM c WHERE NOT regexp_matches(file_path, '/es/[0-9]{{3}}[.]'))"""
KEPT_SQL = f"""{_NOW} SELECT directory_path, count(doc_id) AS total, count(*) FILTER (state = '{schemas.INDEXED}') AS indexed, count(*) FILTER (state = '{schemas.ERROR}') AS failed,
CASE WHEN count(doc_id) = 0 THEN '0%' ELSE printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (state = '{schemas.INDEXED}') / count(doc_id)) END AS rate
FROM {values_sql([(d,) for d in DIRECTORIES], 'directory_path')} LEFT JOIN d ON starts_with(file_path, directory_path) GROUP BY 1"""
KEPT_LEVELS_SQL = f"""{_NOW}, p AS (SELECT string_split(substr(file_path, 2), '/') AS x FROM d)
SELECT level::INT AS level, count(DISTINCT array_to_string(x[1:level], '/')) AS prefixes FROM p, range(1, 5) r(level) WHERE level <= len(x) GROUP BY 1"""


def similar_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the turns of users, those like a conversation's first one."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    asked = turns.filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("question"))
    every = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return rounded(similar.similar_pairs(asked, every, 0.75), "similarity")


PAIRS_SQL = r"""WITH u AS (SELECT conv_id, turn, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2))) AS gram FROM u) GROUP BY ALL),
z AS (SELECT conv_id, turn, sum(n) AS total FROM g GROUP BY ALL),
s AS (SELECT a.conv_id AS asked_id, b.conv_id * 1000 + b.turn AS id, sum(least(a.n, b.n)) AS shared, a.conv_id AS x, b.conv_id AS y, b.turn AS w FROM g a JOIN g b USING (gram) WHERE a.turn = 0 GROUP BY ALL)
SELECT asked_id, id, round(2.0::DOUBLE * shared / (p.total + q.total), 6) AS similarity FROM s JOIN z p ON p.conv_id = x AND p.turn = 0 JOIN z q ON q.conv_id = y AND q.turn = w
WHERE 2.0::DOUBLE * shared / (p.total + q.total) >= 0.75"""


def tasks_above_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a task for each document's directory, those at or above a query path."""
    tasks = corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("/corp/"), "source", F.lit("/"), F.when(F.col("doc_id") % 3 > 0, F.concat("lang", F.lit("/"))).otherwise("")).alias("directory_path"))
    return catalog.tasks_above(tasks, "/corp/src1/en/7.md")


TASKS_ABOVE_SQL = f"""WITH {C}, t AS (SELECT doc_id AS id, '/corp/' || source || '/' || CASE WHEN doc_id % 3 > 0 THEN lang || '/' ELSE '' END AS directory_path FROM c)
SELECT id, directory_path FROM t WHERE starts_with('/corp/src1/en/7.md', directory_path)"""


def time_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by time: before, before with a state, and between."""
    c = corpus(spark, sf_dir).select("doc_id", "create_time", "state")
    at = lambda s: F.to_timestamp(F.lit(s))
    kinds = {
        "before": catalog.before(c, "create_time", at("2024-03-01")),
        "state_before": catalog.before(c, "create_time", at("2024-06-01"), F.col("state") == schemas.SAVED),
        "within": catalog.within(c, "create_time", at("2024-05-01"), at("2024-05-31")),
    }
    return catalog.union_all([rows.select(F.lit(kind).alias("kind"), "doc_id") for kind, rows in kinds.items()])


def directories_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.present(values(spark, [("/corp/src1",), ("/corp/none",), ("/corp/src1/en/",)], "path string"), corpus(spark, sf_dir))


def pattern_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore patterns made of documents' paths, trimmed, with whether they are valid."""
    k, c = F.col("doc_id") % 6, corpus(spark, sf_dir)
    made = (
        F.when(k == 0, F.concat(F.lit(" **/"), "source", F.lit("/** "))).when(k == 1, F.concat(F.lit("*."), "ext")).when(k == 2, F.concat(F.lit("-"), "lang"))
        .when(k == 3, F.concat("source", F.lit("|"), "lang")).when(k == 4, F.concat("source", F.lit("/[a-z]?/!"), "lang")).otherwise("  ")
    )
    pattern = c.withColumn("ext", tx.extension(F.col("file_path"))).select(F.trim(made).alias("pattern")).distinct().filter("pattern <> ''")
    return pattern.withColumn("valid", globs.valid(F.col("pattern")))


PATTERN_SQL = rf"""WITH {C}, p AS (SELECT DISTINCT trim(CASE doc_id % 6 WHEN 0 THEN ' **/' || source || '/** ' WHEN 1 THEN '*.' || ext WHEN 2 THEN '-' || lang
WHEN 3 THEN source || '|' || lang WHEN 4 THEN source || '/[a-z]?/!' || lang ELSE '  ' END) AS pattern FROM c)
SELECT pattern, regexp_matches(pattern, '^[A-Za-z0-9_*./\[]') AND regexp_full_match(pattern, '[A-Za-z0-9_*./\[\]\-!? ]+') AS valid FROM p WHERE pattern <> ''"""


def worker_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each worker's first ten saved documents."""
    c = corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws(".", F.col("doc_id").cast("string"), "ext").alias("file_name"), "state")
    return catalog.union_all([catalog.worker_page(c, w).select("id", F.lit(w).alias("worker")) for w in range(4)])


WORKER_SQL = f"""WITH {C}, w AS (SELECT doc_id AS id, (('0x' || substr(md5(doc_id || '.' || ext), 1, 8))::BIGINT % 4)::INT AS worker FROM c WHERE state = '{schemas.SAVED}')
SELECT id, worker FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY id) AS k FROM w) WHERE k <= 10"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return lines.select("doc_id", "ord", F.length("line").cast("long").alias("size"))


def batch_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that stay below the cap."""
    return chunk.batches(_lines(spark, sf_dir), "doc_id", "ord", "size", 600, strict=True).select("doc_id", "ord", "batch")


def batch_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose joined length counts a separator between lines."""
    return chunk.batches(_lines(spark, sf_dir), "doc_id", "ord", "size", 600, sep=1).select("doc_id", "ord", "batch")


BATCH_STRICT_SQL = BATCH_SQL.replace("<= 600", "< 600")
BATCH_SEPARATOR_SQL = BATCH_SQL.replace("r.total + i.size", "r.total + 1 + i.size")


def facts_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.length_of(facts_extract(spark, sf_dir), 2_000)


def reduced_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts cut by half, batch by batch, until they fit or three rounds have passed."""
    rows = facts_extract(spark, sf_dir).select("para_id", "seq", "fact")
    refine = lambda b: b.select("para_id", "seq", F.expr("substring(fact, 1, int(ceil(length(fact) / 2)))").alias("fact"))
    return facts.reduce_facts(rows, refine, budget=4_000)


HALVED = lambda x: f"substr({x}, 1, ceil(length({x}) / 2)::INT)"
REDUCED_SQL = f"""WITH {FACTS}, r0 AS (SELECT para_id, seq, fact FROM f),
r1 AS (SELECT para_id, seq, CASE WHEN (SELECT sum(length(fact)) FROM r0) > 4000 THEN {HALVED('fact')} ELSE fact END AS fact FROM r0),
r2 AS (SELECT para_id, seq, CASE WHEN (SELECT sum(length(fact)) FROM r1) > 4000 THEN {HALVED('fact')} ELSE fact END AS fact FROM r1),
r3 AS (SELECT para_id, seq, CASE WHEN (SELECT sum(length(fact)) FROM r2) > 4000 THEN {HALVED('fact')} ELSE fact END AS fact FROM r2)
SELECT para_id, seq::INT AS seq, fact FROM r3"""


def result_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result lists one behind the other, what both hold twice."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return search.bag_union([b.filter("item_id % 2 = 0"), b.filter("item_id % 3 = 0")])


def distinct_fact_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts_extract(spark, sf_dir).withColumn("task_id", F.col("seq") % 4)
    return facts.paragraphs_of_task(own, 1)


def cleaned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.clean_query(F.col("text")).alias("query"))


def unquoted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", plugins.unquoted(tx.tokens(F.col("text"))).alias("terms"))


def quoted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", plugins.quoted(tx.tokens(F.col("text"))).alias("quoted"))


def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), (-F.col("item_id")).alias("rank"), F.col("text").alias("content"))
    ids = plugins.overlap_rerank(hits, "the of and in thing")
    return search.rerank(hits.select("doc_id"), ids)


RERANK_SQL = f"""WITH h AS (SELECT item_id AS doc_id, len(list_intersect(['the', 'of', 'and', 'in', 'thing'], {tokens_sql('text')})) AS s FROM benchmark)
SELECT doc_id, (row_number() OVER (ORDER BY s DESC, -doc_id) - 1)::INT AS pos FROM h"""


def directory_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories submitted before a time and still indexing."""
    c = corpus(spark, sf_dir)
    rows = c.select("doc_id", F.when(F.col("lang") == "en", "indexing").otherwise(schemas.COMPLETED).alias("index_status"), F.col("create_time").alias("submit_time"))
    return catalog.stale(rows, F.to_timestamp(F.lit("2024-06-01"))).select("doc_id")


QUERIES = {
    "prefix_semi_join": (prefix_semi_join, f"WITH {C} SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM c WHERE starts_with(file_path, '/corp/src1'))"),
    "configured_instances": (configured_instances, f"SELECT DISTINCT source AS template_id, lang, body FROM documents JOIN {values_sql(TEMPLATES, 'id, body')} ON id = source"),
    "orphan_templates": (orphan_templates, f"SELECT id AS template_id, body FROM {values_sql(TEMPLATES, 'id, body')} WHERE id NOT IN (SELECT source FROM documents)"),
    "keyword_paths": (keyword_paths, f"WITH {C} SELECT file_path FROM c WHERE contains(lower(file_path), 'src1/en')"),
    "gone_paths": (gone_paths, f"WITH {C} SELECT DISTINCT file_path FROM c WHERE lang = 'fr'"),
    "web_results": (web_results, WEB_SQL),
    "valid_facts": (valid_facts, f"WITH {C}, {FACTS} SELECT f.para_id, f.seq::INT AS seq, fact, file_path AS url FROM f JOIN c ON c.doc_id = f.para_id WHERE lang <> 'de'"),
    "single_batches": (single_batches, "SELECT doc_id, k - 1 AS ord, k AS batch FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS k FROM documents)"),
    "unfinished_paragraphs": (unfinished_paragraphs, "SELECT doc_id AS para_id, lang FROM documents WHERE doc_id > 500"),
    "setting_values": (setting_values, SETTINGS_SQL),
    "fetched_content": (fetched_content, f"SELECT pos, id::BIGINT AS para_id, 0 AS ord, coalesce(text, '') AS content FROM {values_sql(list(enumerate(ASKED)), 'pos, id')} LEFT JOIN documents ON doc_id = id"),
    "simple_search": (simple_search, SIMPLE_SQL),
    "task_counters": (task_counters, TASK_SQL),
    "kept_directory_status": (kept_directory_status, KEPT_SQL),
    "kept_level_counts": (kept_level_counts, KEPT_LEVELS_SQL),
    "similar_question_pairs": (similar_question_pairs, PAIRS_SQL),
    "tasks_above_path": (tasks_above_path, TASKS_ABOVE_SQL),
    "time_predicates": (time_predicates, f"WITH {C} SELECT 'before' AS kind, doc_id FROM c WHERE create_time < TIMESTAMP '2024-03-01' UNION ALL SELECT 'state_before', doc_id FROM c WHERE create_time < TIMESTAMP '2024-06-01' AND state = '{schemas.SAVED}' UNION ALL SELECT 'within', doc_id FROM c WHERE create_time BETWEEN TIMESTAMP '2024-05-01' AND TIMESTAMP '2024-05-31'"),
    "directories_exist": (directories_exist, f"WITH {C} SELECT p AS path, EXISTS (SELECT 1 FROM c WHERE starts_with(file_path, rtrim(p, '/') || '/')) AS present FROM (VALUES ('/corp/src1'), ('/corp/none'), ('/corp/src1/en/')) v(p)"),
    "pattern_validation": (pattern_validation, PATTERN_SQL),
    "worker_pages": (worker_pages, WORKER_SQL),
    "batch_strict": (batch_strict, BATCH_STRICT_SQL),
    "batch_separator": (batch_separator, BATCH_SEPARATOR_SQL),
    "facts_length": (facts_length, f"WITH {FACTS} SELECT coalesce(sum(length(fact)), 0)::BIGINT AS total, coalesce(sum(length(fact)), 0) <= 2000 AS within FROM f"),
    "reduced_facts": (reduced_facts, REDUCED_SQL),
    "result_bag": (result_bag, "SELECT item_id, 0 AS q FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 1 FROM benchmark WHERE item_id % 3 = 0"),
    "distinct_fact_paragraphs": (distinct_fact_paragraphs, f"WITH {FACTS} SELECT DISTINCT para_id FROM f WHERE seq % 4 = 1"),
    "cleaned_queries": (cleaned_queries, "SELECT item_id, trim(regexp_replace(coalesce(text, ''), '[,.]+', ' ', 'g')) AS query FROM benchmark"),
    "unquoted_terms": (unquoted_terms, f"SELECT item_id, array_to_string({tokens_sql('text')}, ' ') AS terms FROM benchmark"),
    "quoted_terms": (quoted_terms, f"SELECT item_id, array_to_string(list_transform({tokens_sql('text')}, lambda t: '\"' || t || '\"'), ' ') AS quoted FROM benchmark"),
    "overlap_rerank": (overlap_rerank, RERANK_SQL),
    "directory_times": (directory_times, f"WITH {C} SELECT doc_id FROM c WHERE lang = 'en' AND create_time < TIMESTAMP '2024-06-01'"),
}
