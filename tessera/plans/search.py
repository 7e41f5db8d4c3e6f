"""Search queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segmentation
from ..operators import index, search, words
from .base import C, corpus, docs, rounded, scratch, table, tokens_sql, values, values_sql

TERMS = ["license", "apache", "version"]
PHRASE, REQUIRED, OPTIONAL, PREFIX = "public license", "license", "version", "/corp/src1"
FUZZY = "released, licence"
AS_OF, DAYS = "2024-12-31 00:00:00", 180


def counted_sql(terms: list[str], source: str = "documents", extra: str = "") -> str:
    """CTEs t (doc_id, tk), s (tf per term) and g (statistics)."""
    tf = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    return f"""t AS (SELECT doc_id, {tokens_sql('text')} AS tk{extra} FROM {source}),
s AS (SELECT doc_id, len(tk) AS dl, {tf}{extra and ', ' + extra.lstrip(', ')} FROM t),
g AS (SELECT count(*) AS n, greatest(avg(dl), 1e-9) AS avgdl, {df} FROM s)"""


def _weight(tf: str) -> str:
    return f"(CASE WHEN {tf} > 0 THEN {tf} / ({tf} + {search.K1}::DOUBLE * (1 - {search.B}::DOUBLE + {search.B}::DOUBLE * dl / avgdl)) ELSE 0 END)"


def _idf(k: int) -> str:
    return f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE))"


def score_sql(ks: list[int]) -> str:
    return "(" + " + ".join(["0.0::DOUBLE", *(f"{_idf(k)} * {_weight(f'tf{k}')}" for k in ks)]) + ")"


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.top(search.bm25(docs(spark, sf_dir).select("doc_id", "text"), TERMS), 10), "score")


BM25_SQL = f"""WITH {counted_sql(TERMS)}, h AS (SELECT doc_id, {score_sql([0, 1, 2])} AS score FROM s, g)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM h WHERE score > 0 ORDER BY h.score DESC, doc_id LIMIT 10"""


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from postings of the query's terms, picked within the rows."""
    source = search.Scan(docs(spark, sf_dir))
    own = source.of_terms(TERMS)
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = search.idf(F.col("n"), F.col("df")) * search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    scored = own.join(F.broadcast(df), "term").join(F.broadcast(source.sized())).groupBy("doc_id").agg(F.sum(one).alias("score"))
    return rounded(scored, "score", places=5)


BM25_ALL_SQL = f"WITH {counted_sql(TERMS)}, h AS (SELECT doc_id, {score_sql([0, 1, 2])} AS score FROM s, g) SELECT doc_id, round(score, 5) AS score FROM h WHERE score > 0"


STRATEGY = search.SearchQuery(exact=(PHRASE,), required=(REQUIRED,), optional=(OPTIONAL,), path_prefix=PREFIX)


def search_strategy_dismax(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.strategy(corpus(spark, sf_dir).select("doc_id", "text", "file_path"), STRATEGY)
    return rounded(search.top(hits, 30), "score")


def _windows_sql(source: str, words: list[str], slop: int) -> str:
    """CTEs ev and f (doc_id, pf): the sloppy frequency of a phrase of two words in t (doc_id, tk)."""
    slot = " ".join(f"WHEN '{w}' THEN {k}" for k, w in enumerate(words))
    return f"""ev AS (SELECT doc_id, i - s AS spot, s FROM (SELECT doc_id, i, CASE tk[i + 1] {slot} END AS s FROM (SELECT doc_id, tk, unnest(range(len(tk))) AS i FROM {source})) WHERE s IS NOT NULL),
lagged AS (SELECT doc_id, spot, s, lag(spot) OVER w AS lo, lag(s) OVER w AS ls FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY spot, s)),
f AS (SELECT doc_id, sum(1 / (1 + moves)::DOUBLE) AS pf FROM (SELECT doc_id, lo, min(spot - lo) AS moves FROM lagged WHERE ls <> s AND spot - lo <= {slop} GROUP BY ALL) GROUP BY doc_id)"""


def _dismax_sql() -> str:
    terms = [REQUIRED, OPTIONAL, *(t for t in PHRASE.split() if t not in (REQUIRED, OPTIONAL))]
    words = PHRASE.split()
    rarity = " + ".join(_idf(terms.index(w)) for w in words)
    phrase = f"{search.BOOSTS['phrase']}::DOUBLE * ({rarity}) * {_weight('coalesce(pf, 0)')}"
    required, optional = (f"{search.BOOSTS[b]}::DOUBLE * {score_sql([k])}" for b, k in (("required", 0), ("optional", 1)))
    return f"""WITH {C}, {counted_sql(terms, 'c', ', file_path')},
{_windows_sql('t', words, search.SLOP)},
k AS (SELECT doc_id, file_path, {phrase} AS a, {required} AS b, {optional} AS o FROM s LEFT JOIN f USING (doc_id), g),
r AS (SELECT doc_id, file_path, greatest(a, b, o) + {search.TIE}::DOUBLE * (a + b + o - greatest(a, b, o)) AS score FROM k WHERE file_path LIKE '{PREFIX}%'),
h AS (SELECT doc_id, file_path, score + 1 AS score FROM r WHERE score > 0)
SELECT doc_id, file_path, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM h ORDER BY h.score DESC, doc_id LIMIT 30"""


def _built(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    own = index.TextIndex(spark, scratch(spark, "text-index"), 16)
    own.build(docs(spark, sf_dir).select("doc_id", "text"))
    return own


def indexed_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy from postings and positions: the buckets of its terms only."""
    hits = _built(spark, sf_dir).strategy(STRATEGY).join(corpus(spark, sf_dir).select("doc_id", "file_path", "create_time"), "doc_id")
    return rounded(search.top(search.restricted(hits, STRATEGY).select("doc_id", "file_path", "score"), 30), "score")


def indexed_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_built(spark, sf_dir).fallback(FUZZY), "score")


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 after documents were replaced (every seventh by its first 200 characters) and removed (every fifth)."""
    own, d = _built(spark, sf_dir), docs(spark, sf_dir).select("doc_id", "text")
    own.update(d.filter("doc_id % 7 = 0").withColumn("text", F.substring("text", 1, 200)))
    own.delete(d.filter("doc_id % 5 = 0").select("doc_id"))
    return rounded(own.bm25(TERMS), "score", places=5)


UPDATED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 200) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"
UPDATE_SQL = f"WITH {counted_sql(TERMS, UPDATED)}, h AS (SELECT doc_id, {score_sql([0, 1, 2])} AS score FROM s, g) SELECT doc_id, round(score, 5) AS score FROM h WHERE score > 0"

SYNTAX = 'lic* AND "apache license" NOT cc vershun'


def fallback_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain query with a prefix, AND, a phrase, NOT and a fuzzy last word."""
    return rounded(search.fuzzy(docs(spark, sf_dir).select("doc_id", "text"), SYNTAX), "score")


def _syntax_sql() -> str:
    return f"""WITH {counted_sql(['apache', 'license', 'cc'])},
{_windows_sql('t', ['apache', 'license'], 0)},
e AS (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM e GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
near AS (SELECT term, df, greatest(1 - levenshtein(term, 'vershun') / least(length(term), 7)::DOUBLE, 0) AS share FROM df
  WHERE levenshtein(term, 'vershun') <= {search.EDITS} ORDER BY levenshtein(term, 'vershun'), term LIMIT {search.EXPANSIONS}),
fz AS (SELECT doc_id, sum(share * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * {_weight('tf')}) AS z FROM tf JOIN near USING (term), g GROUP BY doc_id),
pre AS (SELECT DISTINCT doc_id FROM e WHERE term LIKE 'lic%')
SELECT doc_id, round(1 + ({_idf(0)} + {_idf(1)}) * {_weight('pf')} + coalesce(z, 0), 6) AS score
FROM s JOIN f USING (doc_id) JOIN pre USING (doc_id) LEFT JOIN fz USING (doc_id), g WHERE tf2 = 0"""


def search_fuzzy_last_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.fuzzy(docs(spark, sf_dir).select("doc_id", "text"), FUZZY), "score")


FUZZY_SQL = f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents),
z AS (SELECT count(*) AS n, greatest(avg(len(tk)), 1e-9) AS avgdl FROM t),
e AS (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM t), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM e GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
near AS (SELECT term, df, greatest(1 - levenshtein(term, 'licence') / least(length(term), 7)::DOUBLE, 0) AS share FROM df
  WHERE levenshtein(term, 'licence') <= {search.EDITS} ORDER BY levenshtein(term, 'licence'), term LIMIT {search.EXPANSIONS}),
u AS (SELECT term, df, sum(share) AS share FROM (SELECT * FROM near UNION ALL SELECT term, df, 1.0 FROM df WHERE term = 'released') GROUP BY ALL)
SELECT doc_id, round(sum(share * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * {_weight('tf')}), 6) AS score FROM tf JOIN u USING (term), z GROUP BY doc_id"""


def search_recent_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.SearchQuery(required=("license",), last_n_days=DAYS, as_of=AS_OF)
    hits = search.strategy(corpus(spark, sf_dir).select("doc_id", "text", "create_time"), q)
    best = search.top(hits, 10, by_time=True)
    return best.select("rank", "doc_id", F.date_format("create_time", "yyyy-MM-dd").alias("created"), F.round("score", 6).alias("score"))


RECENT_SQL = f"""WITH {C}, {counted_sql(['license'], 'c', ', create_time')},
h AS (SELECT doc_id, create_time, 1 + {search.BOOSTS['required']}::DOUBLE * {score_sql([0])} AS score FROM s, g WHERE tf0 > 0 AND create_time BETWEEN TIMESTAMP '{AS_OF}' - to_days({DAYS}) AND TIMESTAMP '{AS_OF}')
SELECT row_number() OVER (ORDER BY create_time DESC, doc_id)::INT AS rank, doc_id, strftime(create_time, '%Y-%m-%d') AS created, round(score, 6) AS score
FROM h ORDER BY h.create_time DESC, doc_id LIMIT 10"""


def search_topup_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "text")
    return rounded(search.top_up(search.bm25(d, ["gnu"]), search.bm25(d, ["license"]), 30), "score")


TOPUP_SQL = f"""WITH {counted_sql(['gnu', 'license'])}, h AS (SELECT doc_id, 0 AS part, {score_sql([0])} AS score FROM s, g UNION ALL SELECT doc_id, 1, {score_sql([1])} FROM s, g),
b AS (SELECT doc_id, part, score, row_number() OVER (PARTITION BY doc_id ORDER BY part, score DESC) AS k FROM h WHERE score > 0)
SELECT doc_id, part::INT AS part, round(score, 6) AS score FROM b WHERE k = 1 ORDER BY part, b.score DESC, doc_id LIMIT 30"""


def snippet_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = docs(spark, sf_dir).select("doc_id", "text").filter(F.lower("text").contains("license"))
    return search.snippets(hits, ["license", "version"]).select("doc_id", "snippet")


SNIPPET_SQL = r"""WITH d AS (SELECT doc_id, text FROM documents WHERE contains(lower(text), 'license')),
k AS (SELECT doc_id, k, substr(text, k * 300 + 1, 300) AS f FROM (SELECT doc_id, text, unnest(range(0, ceil(greatest(length(text), 1) / 300)::INT)) AS k FROM d)),
h AS (SELECT *, len(regexp_extract_all(f, '(?i)\b(license|version)\b')) AS hits FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, k) AS n FROM h)
SELECT doc_id, CASE WHEN hits > 0 THEN regexp_replace(f, '(?i)\b(license|version)\b', '<B>\1</B>', 'g') ELSE 'No match found' END AS snippet FROM b WHERE n = 1"""


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).statistics()


STATISTICS_SQL = f"""WITH e AS (SELECT unnest({tokens_sql('text')}) AS term FROM documents)
SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(*) AS total_tf FROM e"""

STEMS = "licensed releases rights"


def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by stems: any form of the query's words."""
    own = index.TextIndex(spark, scratch(spark, "text-index"), 16, analyzer=search.STEMMED)
    own.build(docs(spark, sf_dir).select("doc_id", "text"))
    return rounded(own.bm25(search.STEMMED.query(STEMS)), "score", places=5)


#: The forms of the query's words that have their stems.
FORMS = ["licens(e|es|ed|ing|er|ers|able)?", "releas(e|es|ed|ing|er|ers|able)?", "right(s|ed|ing|er|ers|ful|fully)?"]
_FORM_TF = ", ".join(f"len(list_filter(tk, lambda x: regexp_full_match(x, '{f}'))) AS tf{k}" for k, f in enumerate(FORMS))
STEMMED_SQL = f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents), s AS (SELECT doc_id, len(tk) AS dl, {_FORM_TF} FROM t),
g AS (SELECT count(*) AS n, greatest(avg(dl), 1e-9) AS avgdl, {', '.join(f'count(*) FILTER (tf{k} > 0) AS df{k}' for k in range(3))} FROM s),
h AS (SELECT doc_id, {score_sql([0, 1, 2])} AS score FROM s, g) SELECT doc_id, round(score, 5) AS score FROM h WHERE score > 0"""


#: All characters but a-z, à-ÿ, œ, points, commas and line ends; as ranges, which Java finds several times faster than those that aren't in a class.
BETWEEN = r"[\x00-\x09\x0B-\x2B\x2D\x2F-\x60\x7B-\xDF\u0100-\u0152\u0154-\x{10FFFF}]"


def segmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations without their blanks, cut into words by a dictionary learned from them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), BETWEEN, "").alias("text"))
    known = words.learn(rows, pattern="[a-zà-ÿœ]+", longest=6, least=8)
    return rows.select("conv_id", "turn", segmentation.cut(F.col("text"), known, "[a-zà-ÿœ]+").alias("terms"))


IDS = [44, 7, 99999999, 3, 21, 7]


def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = docs(spark, sf_dir).select("doc_id", "lang")
    return search.rerank(hits, values(spark, [(IDS,)], "ids array<long>"))


RERANK_SQL = f"WITH o AS (SELECT id, min(pos) - 1 AS pos FROM {values_sql([(x, k + 1) for k, x in enumerate(IDS)], 'id, pos')} GROUP BY id) SELECT doc_id, lang, pos::INT AS pos FROM documents JOIN o ON id = doc_id"


def multi_query_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    hits = p.select((F.col("page_id") % 3).alias("q"), F.col("page_id").alias("pos"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("title"))
    return search.quota(hits, 3, 20).select("q", "pos", "title")


QUOTA_SQL = """WITH h AS (SELECT page_id % 3 AS q, page_id AS pos, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS title FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY q, pos) AS k FROM h), s AS (SELECT q, pos, title, row_number() OVER (PARTITION BY q ORDER BY pos) AS n FROM f WHERE k = 1)
SELECT q, pos, title FROM s WHERE n <= 7 ORDER BY q, pos LIMIT 20"""


def dedup_url_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "url")
    return search.first_of(p, "host", "page_id")


FIRST_SQL = """SELECT page_id, host, url FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, url,
row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS k FROM pages) WHERE k = 1"""


def hit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    hits = values(spark, [(k + 1, x, 1.0 / (k + 1)) for k, x in enumerate([12, 5, 999999, 40])], "rank int, para_id long, score double")
    paragraphs = c.filter("lang <> 'de'").select(F.col("doc_id").alias("para_id"), "doc_id", F.col("text").alias("content"))
    documents = c.select(F.col("doc_id").alias("id"), F.concat_ws(".", F.col("doc_id").cast("string"), "ext").alias("file_name"), "file_path")
    return search.answers(hits, paragraphs, documents)


HIT_SQL = f"""WITH {C}, h AS (SELECT * FROM {values_sql([(1, 12, '1'), (2, 5, '1/2'), (3, 999999, '1/3'), (4, 40, '1/4')], 'rank, para_id, w')})
SELECT rank, para_id, 1.0::DOUBLE / rank AS score, d.doc_id || '.' || d.ext AS title, coalesce(p.text, '') AS content, coalesce(d.file_path, 'URL not found') AS url
FROM h LEFT JOIN c p ON p.doc_id = h.para_id AND p.lang <> 'de' LEFT JOIN c d ON d.doc_id = p.doc_id"""


def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return rounded(search.similar_questions(b, ASKED, 0.05), "similarity")


def dice_sql(rows: str, keys: str, column: str, wanted: str) -> str:
    """CTEs ending in `scored`: rows' columns and score, the Dice similarity of column and a text."""
    grams = lambda t: f"unnest(list_transform(range(1, greatest(length({t}), 1)), lambda i: substr({t}, i, 2))) AS gram"
    return f"""bare AS (SELECT {keys}, regexp_replace({column}, '\\s+', '', 'g') AS t FROM {rows}),
g AS (SELECT {keys}, gram, count(*) AS n FROM (SELECT {keys}, {grams('t')} FROM bare) GROUP BY ALL),
w AS (SELECT gram, count(*) AS m FROM (SELECT {grams("'" + ''.join(wanted.split()) + "'")}) GROUP BY ALL),
k AS (SELECT {keys}, sum(least(n, coalesce(m, 0))) AS shared, sum(n) AS total FROM g LEFT JOIN w USING (gram) GROUP BY {keys}),
scored AS (SELECT {rows}.*, coalesce(2.0::DOUBLE * shared / (total + (SELECT sum(m) FROM w)), 0) AS score FROM {rows} LEFT JOIN k USING ({keys}))"""


ASKED = "the onal that in the license of and"
SIMILAR_SQL = f"""WITH b AS (SELECT item_id AS id, text AS question, lower(text) AS low FROM benchmark), {dice_sql('b', 'id', 'low', ASKED)}
SELECT id, question, round(score, 6) AS similarity FROM scored WHERE score >= 0.05"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_SQL),
    "bm25_postings": (bm25_postings, BM25_ALL_SQL),
    "search_strategy_dismax": (search_strategy_dismax, _dismax_sql()),
    "indexed_strategy": (indexed_strategy, _dismax_sql()),
    "indexed_fuzzy": (indexed_fuzzy, FUZZY_SQL),
    "index_update": (index_update, UPDATE_SQL),
    "fallback_syntax": (fallback_syntax, _syntax_sql()),
    "search_fuzzy_last_term": (search_fuzzy_last_term, FUZZY_SQL),
    "search_recent_sorted": (search_recent_sorted, RECENT_SQL),
    "search_topup_dedup": (search_topup_dedup, TOPUP_SQL),
    "snippet_highlight": (snippet_highlight, SNIPPET_SQL),
    "index_statistics": (index_statistics, STATISTICS_SQL),
    "stemmed_search": (stemmed_search, STEMMED_SQL),
    "segmented_terms": (segmented_terms, None),
    "rerank_order": (rerank_order, RERANK_SQL),
    "multi_query_quota": (multi_query_quota, QUOTA_SQL),
    "dedup_url_first": (dedup_url_first, FIRST_SQL),
    "hit_join": (hit_join, HIT_SQL),
    "similar_questions": (similar_questions, SIMILAR_SQL),
}
