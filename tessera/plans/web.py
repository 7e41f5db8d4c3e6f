"""Web page and reference-text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search
from ..sources import web
from .base import docs, rounded, table
from .search import dice_sql


WANTED = "the information about this"


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.html_text(F.col("html")).alias("text"), web.page_title(F.col("html")).alias("title"))


def _html_sql(column: str) -> str:
    t = f"regexp_replace(coalesce({column}, ''), '(?is)<(script|style|head|noscript)\\b[^>]*>.*?</(script|style|head|noscript)>|<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{sign}')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'))"


HTML_SQL = f"SELECT page_id, {_html_sql('html')} AS text, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages"


def best_section_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.split(web.html_text(F.col("html")), "\n").alias("parts"))
    sections = p.select("page_id", F.posexplode("parts").alias("ord", "content"))
    return rounded(search.best_section(sections, "page_id", F.lit(WANTED)), "score")


DICE_SQL = f"""WITH p AS (SELECT page_id, string_split({_html_sql('html')}, chr(10)) AS parts FROM pages),
s AS (SELECT page_id, k - 1 AS ord, parts[k] AS content FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)),
{dice_sql('s', 'page_id, ord', 'content', WANTED)},
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS n FROM scored WHERE score > 0) SELECT page_id, ord::INT AS ord, content, round(score, 6) AS score FROM b WHERE n = 1"""


def reference_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = docs(spark, sf_dir)
    raw = F.concat(F.lit("## <h2>"), F.col("doc_id").cast("string"), F.lit("</h2><br/>"), F.col("text"), F.lit("... and  more…"))
    return p.select("doc_id", tx.reference_text(raw).alias("reference"), tx.snippet_noise(raw).alias("snippet"), tx.title(F.col("text")).alias("title"))


CLEAN_SQL = r"""WITH p AS (SELECT doc_id, '## <h2>' || doc_id || '</h2><br/>' || text || '... and  more…' AS raw, text AS head FROM documents),
x AS (SELECT doc_id, raw, trim(regexp_extract(head, '(?m)^#[ \t]*([^#\s][^\n]*)$', 1)) AS a, trim(regexp_extract(head, '(?m)^[ \t]*(\S[^\n]*)$', 1)) AS b FROM p)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '</?h[1-6]>', '', 'g'), '\n|<br\s*/?>', ' ', 'g'), '^#+\s*', '') AS reference,
trim(regexp_replace(raw, '(\s|\.\.\.|…)+', ' ', 'g')) AS snippet, CASE WHEN a <> '' THEN a ELSE b END AS title FROM x"""


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(web.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


QUERIES = {
    "html_text": (html_text, HTML_SQL),
    "best_section_dice": (best_section_dice, DICE_SQL),
    "reference_cleanup": (reference_cleanup, CLEAN_SQL),
    "page_hosts": (page_hosts, "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1"),
}
