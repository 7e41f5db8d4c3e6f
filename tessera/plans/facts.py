"""Fact, batch, task, chat and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunk, facts, search, tables
from ..streaming import events
from .base import C, corpus, docs, table, tokens_sql, values, values_sql

QUESTION = "released under the license version"
TERMS = sorted(set(QUESTION.split()))
TASKS = [(1, "/corp/src0/", "licensed under the license"), (2, "/corp/src1/en/", "all rights reserved"), (3, "/corp/src2/", "released license")]
_WANTED = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def _sentences(content: str) -> str:
    return f"regexp_extract_all({content}, '[^.!?\\n]+[.!?]*')"


def _seq(content: str) -> str:
    """Sentences that aren't blank, trimmed, numbered from 0."""
    return f"list_filter(list_transform({_sentences(content)}, lambda s: trim(s)), lambda s: s <> '')"


def facts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("para_id"), F.col("text").alias("content"))
    return facts.extract(rows, F.lit(QUESTION)).select("para_id", "seq", "fact")


FACTS = f"""s AS (SELECT doc_id AS para_id, {_seq('text')} AS ss FROM documents),
x AS (SELECT para_id, k - 1 AS seq, ss[k] AS fact FROM (SELECT para_id, ss, unnest(range(1, len(ss) + 1)) AS k FROM s)),
f AS (SELECT * FROM x WHERE len(list_intersect({_WANTED}, {tokens_sql('fact')})) / {len(TERMS)}::DOUBLE >= {facts.OVERLAP})"""


def facts_by_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.by_paragraph(facts_extract(spark, sf_dir))


def _task_rows(spark: SparkSession) -> DataFrame:
    return values(spark, TASKS, "id long, directory_path string, key_question string")


def refinery_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks over the paragraphs below their directories, paragraphs done before left out."""
    rows = corpus(spark, sf_dir).select("doc_id", "lang", "file_path", F.col("doc_id").alias("para_id"), F.col("text").alias("content"))
    done = rows.filter("lang = 'de'").select(F.lit(1).cast("long").alias("task_id"), "para_id")
    return facts.refresh(_task_rows(spark), rows, done).select("task_id", "para_id", "seq", "fact")


REFRESH_SQL = f"""WITH {C}, k AS (SELECT id::BIGINT AS task_id, directory_path, {tokens_sql('q')} AS wanted FROM {values_sql(TASKS, 'id, directory_path, q')}),
s AS (SELECT task_id, doc_id AS para_id, wanted, {_seq('text')} AS ss FROM c JOIN k ON starts_with(file_path, directory_path) WHERE NOT (task_id = 1 AND lang = 'de')),
x AS (SELECT task_id, para_id, wanted, k - 1 AS seq, ss[k] AS fact FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS k FROM s))
SELECT task_id, para_id, seq::INT AS seq, fact FROM x WHERE len(list_intersect(list_distinct(wanted), {tokens_sql('fact')})) / len(list_distinct(wanted))::DOUBLE >= {facts.OVERLAP}"""


def refinery_maintain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after the French documents were changed to upper case and the Spanish ones deleted."""
    c = corpus(spark, sf_dir)
    rows = c.select("doc_id", "lang", "file_path", F.col("doc_id").alias("para_id"), F.col("text").alias("content"))
    tasks = _task_rows(spark)
    before = facts.refresh(tasks, rows).drop("seq")
    changed = rows.filter("lang IN ('fr', 'es')")
    now = changed.filter("lang = 'fr'").withColumn("content", F.upper("content"))
    after = facts.maintain(before, facts.affected(changed, tasks), facts.refresh(tasks, now).drop("seq"))
    return after.groupBy("task_id").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length("fact")).alias("length"))


MAINTAIN_SQL = f"""WITH {C}, k AS (SELECT id::BIGINT AS task_id, directory_path, {tokens_sql('q')} AS wanted FROM {values_sql(TASKS, 'id, directory_path, q')}),
n AS (SELECT doc_id, file_path, CASE WHEN lang = 'fr' THEN upper(text) ELSE text END AS content FROM c WHERE lang <> 'es'),
s AS (SELECT task_id, doc_id, wanted, {_seq('content')} AS ss FROM n JOIN k ON starts_with(file_path, directory_path)),
x AS (SELECT task_id, doc_id, wanted, unnest(ss) AS fact FROM s)
SELECT task_id, count(*) AS facts, count(DISTINCT doc_id) AS documents, sum(length(fact))::BIGINT AS length FROM x
WHERE len(list_intersect(list_distinct(wanted), {tokens_sql('fact')})) / len(list_distinct(wanted))::DOUBLE >= {facts.OVERLAP} GROUP BY 1"""


def similar_question_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    own = facts_extract(spark, sf_dir).withColumn("task_id", F.col("para_id") % 3 + 1).select("task_id", "para_id", "fact")
    tasks = values(spark, [(1, 2), (2, 0), (3, 1)], "task_id long, pos int")
    stored = own.unionByName(own.select((F.col("task_id") % 3 + 1).alias("task_id"), "para_id", F.upper("fact").alias("fact")))
    return facts.of_similar(stored, c.select(F.col("doc_id").alias("para_id"), "doc_id"), c.select("doc_id", "file_path"), tasks, "/corp/src1")


SIMILAR_SQL = f"""WITH {C}, {FACTS}, t AS (SELECT * FROM {values_sql([(1, 2), (2, 0), (3, 1)], 'task_id, pos')}),
a AS (SELECT para_id % 3 + 1 AS task_id, para_id, fact FROM f UNION ALL SELECT (para_id % 3 + 1) % 3 + 1, para_id, upper(fact) FROM f),
r AS (SELECT a.para_id, a.task_id, fact, file_path, row_number() OVER (PARTITION BY a.para_id ORDER BY pos, a.task_id, fact COLLATE C) AS k FROM a JOIN t USING (task_id) JOIN c ON c.doc_id = a.para_id WHERE starts_with(file_path, '/corp/src1'))
SELECT para_id, task_id, fact, file_path FROM r WHERE k = 1"""


def task_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, [facts.PENDING, facts.PROCESSING, facts.ACTIVE, facts.FAILED]))
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.element_at(names, (F.col("item_id") % 4 + 1).cast("int")).alias("status"))
    outcome = tasks.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "timeout").alias("error"))
    return facts.status_counts(facts.settle(tasks, outcome))


STATUS_SQL = """WITH t AS (SELECT item_id AS id, ['pending', 'processing', 'active', 'failed'][item_id % 4 + 1] AS status FROM benchmark)
SELECT CASE WHEN status <> 'active' AND id % 3 <> 0 THEN CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'active' END ELSE status END AS status, count(*) AS tasks FROM t GROUP BY 1"""


def fact_distinct_paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts_extract(spark, sf_dir).withColumn("task_id", F.col("seq") % 4)
    return facts.paragraphs_by_task(own)


def fact_append_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts_extract(spark, sf_dir).withColumn("task_id", F.lit(1))
    first = F.col("fact").contains("work")
    return tables.append_facts(own.filter(first), own.filter(~first))


APPEND_SQL = f"WITH {FACTS} SELECT 1 AS task_id, para_id, string_agg(fact, chr(10) ORDER BY CASE WHEN contains(fact, 'work') THEN 0 ELSE 1 END, seq) AS fact FROM f GROUP BY para_id"


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = facts_extract(spark, sf_dir).select((F.col("para_id") % 5).alias("task_id"), F.lit(QUESTION).alias("prompt"), F.col("fact").alias("response"))
    return facts.token_cost(calls)


def hit_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = values(spark, [(0, 10), (1, None), (9, 4)], "id long, hit_count int")
    return facts.hits_by_task(docs(spark, sf_dir).select((F.col("doc_id") % 3).alias("task_id")), tasks).select("id", F.col("hit_count").cast("long").alias("hit_count"))


HIT_SQL = f"""SELECT id::BIGINT AS id, (coalesce(hit_count, 0) + coalesce(n, 0))::BIGINT AS hit_count FROM {values_sql([(0, 10), (1, None), (9, 4)], 'id, hit_count')}
LEFT JOIN (SELECT doc_id % 3 AS k, count(*) AS n FROM documents GROUP BY 1) ON k = id"""


def batch_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines in batches of at most 600 characters."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    items = lines.select("doc_id", "ord", F.length("line").cast("long").alias("size"))
    return chunk.batches(items, "doc_id", "ord", "size", 600).select("doc_id", "ord", "batch")


BATCH_SQL = """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
i AS (SELECT doc_id, k - 1 AS ord, length(x[k]) AS size FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS k FROM l)),
r AS (SELECT doc_id, ord, size AS total, 0 AS batch FROM i WHERE ord = 0 UNION ALL
SELECT i.doc_id, i.ord, CASE WHEN r.total + i.size <= 600 THEN r.total + i.size ELSE i.size END, CASE WHEN r.total + i.size <= 600 THEN r.batch ELSE r.batch + 1 END
FROM r JOIN i ON i.doc_id = r.doc_id AND i.ord = r.ord + 1) SELECT doc_id, ord::INT AS ord, batch::INT AS batch FROM r"""


def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = docs(spark, sf_dir).select(F.col("doc_id").alias("rank"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    return chunk.prompt(hits, 4000)


PROMPT_SQL = """WITH h AS (SELECT doc_id AS rank, '## doc ' || doc_id || chr(10) || text || chr(10) AS part FROM documents ORDER BY doc_id LIMIT 10),
b AS (SELECT *, coalesce(sum(length(part)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT string_agg(substr(part, 1, (4000 - before)::INT), '' ORDER BY rank) AS prompt, count(*) AS documents FROM b WHERE before < 4000"""


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(docs(spark, sf_dir))


def result_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts_by_paragraph(spark, sf_dir)
    numbered = own.select(F.col("para_id").alias("seq"), F.col("facts").alias("fact"), F.concat(F.lit("/corp/"), F.col("para_id").cast("string")).alias("url"))
    return facts.result_list(numbered).select("results", F.size("urls").alias("urls"))


def chat_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "role", "text")
    return tables.page_back(c, "at", 10, 5)


def chat_cap200(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "role")
    return tables.newest(c, "at", 200)


def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "props")
    k = F.col("event_id") % 9
    around = lambda before, after="": F.concat(F.lit(before), "props", F.lit(after))
    text = (
        F.when(k == 0, around("Here:\n```json\n", "\n```\nDone."))
        .when(k == 1, F.col("props"))
        .when(k == 2, around("The list is [", "] as asked."))
        .when(k == 3, around("Value: ", " end"))
        .when(k == 4, around("Use ", ' or {"b": 2} here'))
        .when(k == 5, around("see [1] and ", " ok"))
        .when(k == 6, around('a } stray { brace "\n[', "] and [3]"))
        .when(k == 7, around('{"s": "} ] \\" {", "t": [', "]} {}"))
        .otherwise(around("```json\n", " and more\n``` [2]"))
    )
    return e.select("event_id", tx.json_candidate(text).alias("json"))


JSON_SQL = """SELECT event_id, CASE event_id % 9 WHEN 2 THEN '[' || props || ']' WHEN 5 THEN '[1]' WHEN 6 THEN '[' || props || ']'
WHEN 7 THEN '{"s": "} ] \\" {", "t": [' || props || ']}' ELSE trim(props) END AS json FROM events"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.windowed(table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", F.round("total", 1).alias("total"))


WINDOW_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(round(sum(value), 2), 1) AS total FROM events GROUP BY 1, 2"


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events.sessions(table(spark, sf_dir, "events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


SESSION_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS c FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(c) AS longest FROM n GROUP BY 1"""


def question_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each rewritten query of a question finds."""
    own = docs(spark, sf_dir).select("doc_id", "text")
    found = None
    for k, q in enumerate(search.queries_of("apache license\n\n  gnu public license \napache license", "mit")):
        hit = search.bm25(own, search.analyze(q)).agg(F.count(F.lit(1)).alias("documents")).select(F.lit(k).alias("q"), F.lit(q).alias("query"), "documents")
        found = hit if found is None else found.unionByName(hit)
    return found


_HOLDS = lambda words: "count(*) FILTER (" + " OR ".join(f"list_contains(tk, '{w}')" for w in words) + ")"
QUESTION_SQL = f"""WITH t AS (SELECT {tokens_sql('text')} AS tk FROM documents)
SELECT 0 AS q, 'mit' AS query, {_HOLDS(['mit'])} AS documents FROM t UNION ALL SELECT 1, 'apache license', {_HOLDS(['apache', 'license'])} FROM t UNION ALL SELECT 2, 'gnu public license', {_HOLDS(['gnu', 'public', 'license'])} FROM t"""

RENDER_SQL = f"""WITH {FACTS}, b AS (SELECT para_id, string_agg(fact, chr(10) ORDER BY seq) AS facts FROM f GROUP BY 1)
SELECT string_agg(para_id || '. ' || facts || ' (/corp/' || para_id || ')', chr(10) ORDER BY para_id) AS results, count(*)::INT AS urls FROM b"""

QUERIES = {
    "facts_extract": (facts_extract, f"WITH {FACTS} SELECT para_id, seq::INT AS seq, fact FROM f"),
    "facts_by_paragraph": (facts_by_paragraph, f"WITH {FACTS} SELECT para_id, string_agg(fact, chr(10) ORDER BY seq) AS facts FROM f GROUP BY 1"),
    "refinery_refresh": (refinery_refresh, REFRESH_SQL),
    "refinery_maintain": (refinery_maintain, MAINTAIN_SQL),
    "similar_question_facts": (similar_question_facts, SIMILAR_SQL),
    "task_status_counts": (task_status_counts, STATUS_SQL),
    "fact_distinct_paras": (fact_distinct_paras, f"WITH {FACTS} SELECT (seq % 4)::INT AS task_id, count(DISTINCT para_id) AS paragraphs FROM f GROUP BY 1"),
    "fact_append_merge": (fact_append_merge, APPEND_SQL),
    "token_cost": (token_cost, f"WITH {FACTS} SELECT para_id % 5 AS task_id, sum(length(fact) + {len(QUESTION)})::BIGINT AS cost FROM f GROUP BY 1"),
    "hit_counter": (hit_counter, HIT_SQL),
    "batch_greedy": (batch_greedy, BATCH_SQL),
    "prompt_budget": (prompt_budget, PROMPT_SQL),
    "chunk_markdown": (chunk_markdown, None),
    "result_rendering": (result_rendering, RENDER_SQL),
    "chat_page": (chat_page, "SELECT * FROM (SELECT conv_id * 1000 + turn AS \"at\", role, text FROM conversations ORDER BY 1 DESC LIMIT 5 OFFSET 10) ORDER BY 1"),
    "chat_cap200": (chat_cap200, "SELECT conv_id * 1000 + turn AS \"at\", role FROM conversations ORDER BY 1 DESC LIMIT 200"),
    "json_from_text": (json_from_text, JSON_SQL),
    "event_windows": (event_windows, WINDOW_SQL),
    "event_sessions": (event_sessions, SESSION_SQL),
    "question_queries": (question_queries, QUESTION_SQL),
}
