"""The inverted index as tables: postings bucketed by term, document lengths, a term dictionary and its neighbourhoods.

A query reads its terms' buckets and joins nothing but the keys of documents that went. An update adds
a segment for the documents it touches and takes effect at one commit, alone (TextIndex.update) or with
the other tables of a store (TextIndex.changes). Texts are tokenised once: lengths, terms and neighbourhoods are taken
from the postings as written.

Terms near a term are looked up by keys, not by comparing with the dictionary. Two terms within EDITS edits share what is
left of both after at most as many deletions, so a term of up to SHORT characters is kept under all of these; of a longer one, cut into
EDITS + 1 pieces, some piece stands unchanged in the other, moved by at most EDITS places, so it is kept under its pieces.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import search
from .tables import Change, Store, Table

BUCKETS = 64
#: Terms that are looked for one by one in a row's tokens.
FEW = 4
#: Longest term that is kept under what deletions leave of it.
SHORT = 6
EDITS = search.EDITS
#: Characters of a text to a token, about.
CHARACTERS = 6
#: Tokens of a document whose places fit two bytes.
NEAR = 1 << 15
#: A character that no term holds.
BETWEEN = "\x00"


def summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


TABLES = {
    "postings": Table("doc_id LONG, term STRING, tf INT, dl INT, positions ARRAY<INT>, bucket INT", "doc_id", ("bucket",), "doc_id", ("term", "doc_id")),
    "lengths": Table("doc_id LONG, dl INT", "doc_id"),
    "terms": Table("term STRING, df LONG, tf LONG", "term", merged=summed),
    "neighbours": Table("key STRING, term STRING, bucket INT", "term", ("bucket",), "term", ("key",), merged=DataFrame.distinct),
}


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_number(value: str, buckets: int) -> int:
    """bucket_of() a constant, without a job: XXH64 with Spark's seed, as a signed number."""
    unsigned = xxhash.xxh64_intdigest(value.encode(), seed=42)
    return (unsigned - (1 << 64) if unsigned >> 63 else unsigned) % buckets


def _runs(df: DataFrame, rows: str, differs: Callable[[Column], Column], of: Callable[[Column, Column], Column]) -> tuple[DataFrame, Column]:
    """df and of(start, length) of each run of neighbouring elements of its array `rows`, where differs() of its place says that a later one starts.

    The starts are a column of df: as an expression they would be worked out again for each run.
    """
    starts = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | differs(i), i)), lambda i: i.isNotNull())
    each = F.transform("__starts", lambda a, k: of(a + 1, F.coalesce(F.get(F.col("__starts"), k + 1), F.size(rows)) - a))
    return df.withColumn("__starts", starts), each


def blocks(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """(doc_id, dl, bucket, terms, places, far): a document's tokens of a bucket, ordered by term and place; terms joined by BETWEEN.

    Their places are most of what is shuffled: two bytes each, in `far` four for a document of more than NEAR tokens. They are sorted and cut within the row, so that no text and no single token is shuffled or sorted between rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    token = lambda x, i: F.struct(bucket_of(x, buckets).alias("bucket"), x.alias("term"), i.alias("place"))
    rows = rows.select("doc_id", F.size("t").alias("dl"), F.sort_array(F.transform("t", token)).alias("s"))
    bucket = lambda i: F.get(F.col("s"), i)["bucket"]
    rows, cut = _runs(rows, "s", lambda i: bucket(i) != bucket(i - 1), lambda start, n: F.slice("s", start, n))
    each = rows.select("doc_id", "dl", F.explode_outer(cut).alias("s")).filter("s IS NOT NULL")  # not explode(): Spark would work out its array a second time to filter by its size
    return each.select("doc_id", "dl", F.get("s", F.lit(0))["bucket"].alias("bucket"), F.array_join("s.term", BETWEEN).alias("terms"), F.when(F.col("dl") <= NEAR, F.col("s.place").cast("array<short>")).alias("places"), F.when(F.col("dl") > NEAR, F.col("s.place")).alias("far"))


def opened(rows: DataFrame) -> DataFrame:
    """The postings of blocks."""
    term = lambda i: F.get(F.col("terms"), i)
    rows, each = _runs(rows.withColumns({"terms": F.split("terms", BETWEEN), "places": F.coalesce(F.col("places").cast("array<int>"), "far")}), "terms", lambda i: term(i) != term(i - 1), lambda start, n: F.struct(term(start - 1).alias("term"), F.slice("places", start, n).alias("positions")))
    return rows.select("doc_id", "dl", "bucket", F.inline_outer(each)).select("doc_id", "term", F.size("positions").alias("tf"), "dl", "positions", "bucket")


def postings(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None, tokens: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """(doc_id, term, tf, dl, positions, bucket), of the given terms only or of all.

    Nothing is shuffled for all terms. Given ones are picked within the row, more than FEW by one pass over its tokens.
    """
    if terms is None:
        return opened(blocks(docs, buckets, id_col, text_col, tokens))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    rows = rows.select("doc_id", tokens(F.col("__text")).alias("t")).filter(F.size("t") > 0)
    if len(terms) > FEW:
        placed = F.transform("t", lambda x, k: F.struct(x.alias("term"), k.alias("pos")))
        picked = rows.select("doc_id", F.size("t").alias("dl"), F.explode(F.filter(placed, lambda p: p["term"].isin(terms))).alias("p"))
        grouped = picked.groupBy("doc_id", "dl", F.col("p.term").alias("term")).agg(F.array_sort(F.collect_list("p.pos")).alias("positions"))
    else:
        pairs = F.array(*(F.struct(F.lit(t).alias("term"), search.positions_in(F.col("t"), t).alias("positions")) for t in dict.fromkeys(terms)))
        grouped = rows.select("doc_id", F.size("t").alias("dl"), F.explode(F.filter(pairs, lambda x: F.size(x["positions"]) > 0)).alias("p")).select("doc_id", "dl", "p.*")
    return grouped.select("doc_id", "term", F.size("positions").alias("tf"), "dl", "positions", bucket_of(F.col("term"), buckets).alias("bucket"))


def _deleted(term: Column) -> Column:
    """What deleting one character of a term leaves, an array."""
    return F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.concat(F.left(term, i - 1), F.substring(term, i + 1, F.length(term))))


def keys_of(term: Column) -> Column:
    """The keys that a term is kept under."""
    left = shorter = F.array(term)
    for _ in range(EDITS):
        shorter = F.array_distinct(F.flatten(F.transform(F.filter(shorter, lambda x: F.length(x) > 0), _deleted)))
        left = F.concat(left, shorter)
    cut = lambda k: F.floor(F.length(term) * k / (EDITS + 1)).cast("int")
    pieces = F.array(*(F.concat(F.lit(f"{k}:"), F.length(term).cast("string"), F.lit(":"), F.substring(term, cut(k) + 1, cut(k + 1) - cut(k))) for k in range(EDITS + 1)))
    return F.when(F.length(term) <= SHORT, F.transform(F.array_distinct(left), lambda x: F.concat(F.lit(":"), x))).otherwise(pieces)


def keys_near(term: str) -> set[str]:
    """The keys under which all terms within EDITS edits of a term are kept."""
    n, out = len(term), set()
    if n - EDITS <= SHORT:
        left = {term}
        out |= {":" + term}
        for _ in range(EDITS):
            left = {x[:i] + x[i + 1 :] for x in left for i in range(len(x))}
            out |= {":" + x for x in left}
    for size in range(max(SHORT + 1, n - EDITS), n + EDITS + 1):
        for k in range(EDITS + 1):
            start, end = size * k // (EDITS + 1), size * (k + 1) // (EDITS + 1)
            for at in range(max(0, start - EDITS), min(n - (end - start), start + EDITS) + 1):
                out.add(f"{k}:{size}:{term[at : at + end - start]}")
    return out


class TextIndex:
    """postings, lengths, terms and neighbours of documents, in a store of their own or of their owner."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = BUCKETS, store: Store | None = None, analyzer: search.Analyzer = search.LATIN):
        self.spark, self.buckets = spark, buckets
        self.use(analyzer)
        self.store = store or Store(spark, location, TABLES, buckets=buckets)

    def use(self, analyzer: search.Analyzer) -> None:
        self.analyzer, self.tokens = analyzer, analyzer.column

    # -- writing ------------------------------------------------------------------------------

    def changes(self, docs: DataFrame | None, gone: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", everything: bool = False) -> dict[str, Change]:
        """What a commit that adds docs and removes the doc_ids of gone does to the index."""
        if docs is None:
            return {name: Change(None, gone, everything) for name in ("postings", "lengths")}
        rows = blocks(docs, self.buckets, id_col, text_col, self.tokens)
        ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))

        def tokens(written: dict[str, DataFrame]) -> int:
            return int(docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // CHARACTERS

        def lengths(written: dict[str, DataFrame]) -> DataFrame:
            held = written["postings"].groupBy("doc_id").agg(F.max("dl").alias("dl"))
            return ids.join(held, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))

        def terms(written: dict[str, DataFrame]) -> DataFrame:
            return written["postings"].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))

        def neighbours(written: dict[str, DataFrame]) -> DataFrame:
            keys = written["terms"].select("term", F.explode(keys_of(F.col("term"))).alias("key"))
            return keys.select("key", "term", bucket_of(F.col("key"), self.buckets).alias("bucket"))

        def keys(written: dict[str, DataFrame]) -> int:
            most = F.when(F.length("term") <= SHORT, sum(math.comb(SHORT, k) for k in range(EDITS + 1))).otherwise(EDITS + 1)
            return written["terms"].agg(F.sum(most)).first()[0] or 0

        return {
            "postings": Change(rows, gone, everything, opened, tokens),
            "lengths": Change(lengths, gone, everything),
            "terms": Change(terms, None, everything),
            "neighbours": Change(neighbours, None, everything, rows=keys),
        }

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.store.commit(self.changes(docs, None, id_col, text_col, everything=True))

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents, in place of those with their ids."""
        self.store.commit(self.changes(docs, docs.select(F.col(id_col).alias("doc_id")), id_col, text_col))

    def delete(self, ids: DataFrame) -> None:
        self.store.commit(self.changes(None, ids.select("doc_id")))

    # -- reading ------------------------------------------------------------------------------

    #: The dictionary may name terms of documents that went.
    exact_dictionary = False

    def postings(self) -> DataFrame:
        return self.store.read("postings")

    def of_terms(self, terms: list[str]) -> DataFrame:
        """Postings of the terms: their partitions only, terms pushed to the scan."""
        if not terms:
            return self.postings().limit(0)
        return self.store.read("postings", only=self._within("term", terms))

    def _within(self, column: str, values: list[str]) -> Column:
        """The rows of some values, in the buckets that hold them only."""
        at = {bucket_number(v, self.buckets) for v in values}
        return F.col("bucket").isin(*at) & F.col(column).isin(values)

    def near(self, term: str, edits: int) -> DataFrame:
        """(d, term) of the dictionary's terms within some edits (at most EDITS) of a term, looked up by their shared keys; some may be of documents that went."""
        if not 0 <= edits <= EDITS:
            raise ValueError(f"terms are kept for up to {EDITS} edits")
        d = F.levenshtein("term", F.lit(term), edits)
        return self.store.read("neighbours", only=self._within("key", sorted(keys_near(term)))).select("term").distinct().select(d.alias("d"), "term").filter("d >= 0")

    def with_prefix(self, prefix: str) -> DataFrame:
        """(doc_id) of documents that hold a term with the prefix."""
        return self.store.read("postings", only=F.col("term").startswith(prefix)).select("doc_id").distinct()

    def sized(self) -> DataFrame:
        """One row: n, avgdl."""
        return self.store.read("lengths").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(0.0)), F.lit(1e-9)).alias("avgdl"))

    def counted(self, terms: list[str]) -> DataFrame:
        """(doc_id, dl, tf_k and pos_k of the terms) of the documents that hold any: one shuffle of their postings."""
        rows = self.of_terms(terms).groupBy("doc_id").agg(
            F.max("dl").alias("dl"), *(F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"pos_{k}") for k, t in enumerate(terms))
        )
        return rows.select("doc_id", "dl", *(F.size(f"pos_{k}").alias(f"tf_{k}") for k in range(len(terms))), *(f"pos_{k}" for k in range(len(terms))))

    def bm25(self, terms: list[str]) -> DataFrame:
        """(doc_id, score)."""
        rows = self.of_terms(terms)
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rows = rows.join(F.broadcast(df), "term").join(F.broadcast(self.sized()))  # the query's terms; one row
        one = search.idf(F.col("n"), F.col("df")) * search.weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
        return rows.groupBy("doc_id").agg(F.sum(one).alias("score"))

    def strategy(self, query: search.SearchQuery) -> DataFrame:
        """(doc_id, score): the same as search.strategy, from postings; prefix and recency are the caller's."""
        terms = query.terms(self.analyzer)
        if not terms:
            return self.spark.createDataFrame([], "doc_id long, score double")
        counted = self.counted(terms)
        sized = self.sized().join(F.broadcast(search.document_counts(counted, len(terms))))  # one row
        return search.scored(counted, sized, query, self.analyzer).select("doc_id", "score")

    def fallback(self, query: str) -> DataFrame:
        """(doc_id, score): the same as search.fallback."""
        return search.fallback(self, query, self.analyzer)

    def statistics(self) -> DataFrame:
        """One row: documents, terms, total_tf; by the dictionary's counts as long as nothing was removed."""
        state = self.store.state()
        counts = self.store.read("terms", state).select("term", "tf")
        if state[1].get("postings", {}).get("gone"):
            counts = self.store.read("postings", state).select("term", "tf")
        t = counts.groupBy("term").agg(F.sum("tf").alias("tf")).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_tf"))
        return self.store.read("lengths", state).agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(t))  # one row


class Committer:
    """Collects single updates and deletes and commits them together, at OPS of them or every SECONDS."""

    OPS, SECONDS = 50, 5.0

    def __init__(self, index: TextIndex, clock: Callable[[], float] = time.monotonic):
        self.index, self.clock = index, clock
        self.pending: dict[int, str | None] = {}
        self.count, self.since = 0, clock()

    def put(self, doc_id: int, text: str) -> None:
        self._add(doc_id, text)

    def delete(self, doc_id: int) -> None:
        self._add(doc_id, None)

    def _add(self, doc_id: int, text: str | None) -> None:
        self.pending[doc_id] = text
        self.count += 1
        self.tick()

    def tick(self) -> bool:
        """Commit if it is time; whether it was."""
        if self.count >= self.OPS or self.count and self.clock() - self.since >= self.SECONDS:
            self.flush()
            return True
        return False

    def flush(self) -> None:
        if self.pending:
            rows = self.index.spark.createDataFrame(list(self.pending.items()), "doc_id long, text string")
            self.index.store.commit(self.index.changes(rows.filter("text IS NOT NULL"), rows.select("doc_id")))
        self.pending, self.count, self.since = {}, 0, self.clock()
