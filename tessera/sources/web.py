"""Web pages: text of HTML, search-result blocks, and an offline search source."""

from __future__ import annotations

import html as entities
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def html_text(page: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; blocks end lines; common entities read."""
    t = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style|head|noscript)\b[^>]*>.*?</(script|style|head|noscript)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def page_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)


def hit_id(url: Column) -> Column:
    """A stable id of a web hit."""
    return F.xxhash64(url)


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[str, str]], attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """(url, final_url, html, error) of urls (url) by a fetcher (url to final url and page).

    A page is asked for up to `attempts` times with linearly growing delays; a page that fails is empty, its last error a column.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url in frame["url"]:
                final, page, error = url, "", None
                for k in range(1, attempts + 1):
                    try:
                        (final, page), error = fetch(url), None
                        break
                    except Exception as e:  # the network's failure, kept as a column after the last attempt
                        error = f"{type(e).__name__}: {e}"[:500]
                        if k < attempts:
                            time.sleep(delay * k)
                out.append((url, final, page, error))
            yield pd.DataFrame(out, columns=["url", "final_url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, final_url string, html string, error string")


def results(pages: DataFrame, wanted: int | None = None) -> DataFrame:
    """Result rows (position, title, url, description, date, is_ad) without ads and nulls, first of each url.

    pages: (position, title, url, description, date, is_ad) as parsed, in result order.
    """
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("url").orderBy("position"))
    kept = pages.filter("NOT is_ad AND title IS NOT NULL AND url IS NOT NULL").withColumn("k", first).filter("k = 1").drop("k")
    return kept.orderBy("position").limit(wanted) if wanted else kept.orderBy("position")


def parse_results(page: str) -> list[tuple[str, str, str, str, bool]]:
    """(title, url, description, date, is_ad) of the result blocks <div class="result">."""
    out = []
    for attrs, block in re.findall(r'(?is)<div class="result([^"]*)"[^>]*>(.*?)</div>', page or ""):
        link = re.search(r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', block)
        if link:
            plain = lambda s: entities.unescape(re.sub(r"<[^>]*>", "", s)).strip()
            about = re.search(r'(?is)<p class="description"[^>]*>(.*?)</p>', block)
            date = re.search(r'(?is)<span class="date"[^>]*>(.*?)</span>', block)
            out.append((plain(link[2]), link[1], plain(about[1]) if about else "", plain(date[1]) if date else "", " ad" in attrs))
    return out


class SearchSource(DataSource):
    """Result pages of a search as a source.

    Option `wanted`: pages are fetched one after the other until that many results that count (no ads, each url once) are found or a page
    is empty; without it all pages are read, one a task. Option `pages` holds saved pages, parted by form feeds; there is no
    network in tests, a deployment subclasses page().
    """

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return "position int, title string, url string, description string, date string, is_ad boolean"

    def page(self, number: int) -> str:
        """The page of a number from 0; empty behind the last."""
        pages = self.options.get("pages", "").split("\f")
        return pages[number] if number < len(pages) else ""

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: SearchSource):
        self.source, self.wanted = source, int(source.options.get("wanted", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(1 if self.wanted else len(self.source.options.get("pages", "").split("\f")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, seen = partition.value, set()
        while True:
            rows = parse_results(self.source.page(number))
            for k, row in enumerate(rows):
                yield (number * 1000 + k, *row)
                if row[0] and row[1] and not row[4]:
                    seen.add(row[1])
            number += 1
            if not self.wanted or len(seen) >= self.wanted or not rows:
                return


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
