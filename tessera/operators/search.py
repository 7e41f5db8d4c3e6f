"""Ranked text search as DataFrame plans.

Two ways to a term's frequency. Without an index, a document's tokens are read once and the query's
terms counted in the row: one scan, a one-row aggregate for the collection's statistics, no shuffle of
texts. With an index, postings bucketed by term are read for the query's terms only (see index.py).
Scores are BM25 with exact lengths: idf * tf / (tf + k1 * (1 - b + b * dl / avgdl)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Ties go to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions import text as tx
from . import bounded, catalog

K1, B, TIE = 1.2, 0.75, 0.1
SLOP, EXPANSIONS, EDITS = 2, 50, 2
BOOSTS = {"phrase": 4.0, "required": 2.0, "optional": 1.0}
#: Candidate terms looked up at a time until EXPANSIONS of them are held by documents.
CANDIDATES = 200


@dataclass(frozen=True)
class SearchQuery:
    exact: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    original: str = ""
    path_prefix: str = ""
    top_n: int = 30
    last_n_days: int = 0
    as_of: str | None = None
    boosts: dict[str, float] = field(default_factory=lambda: dict(BOOSTS))

    def phrases(self, analyzer: Analyzer) -> list[list[str]]:
        return [p for p in map(analyzer.query, self.exact) if p]

    def terms(self, analyzer: Analyzer) -> list[str]:
        """All terms looked up: required and optional ones as they stand, phrases analysed."""
        return list(dict.fromkeys([*self.required, *self.optional, *(t for p in self.phrases(analyzer) for t in p)]))


def analyze(text: str) -> list[str]:
    """A query text's terms, as tokens() makes them."""
    return re.findall(tx.TOKEN, text.lower())


class Analyzer(NamedTuple):
    """Terms of a column of texts and of a query, alike."""

    column: Callable[[Column], Column]
    query: Callable[[str], list[str]]


#: Runs of Latin letters and digits; and stems with two-character terms of scripts without blanks.
LATIN = Analyzer(tx.tokens, analyze)
STEMMED = Analyzer(analysis.tokens, analysis.analyze)


def segmented(words: dict[str, float]) -> Analyzer:
    """Stems, and words of scripts without blanks by a learned dictionary (operators/words.py)."""
    if not words:
        return STEMMED
    cut = analysis.cutter(words)
    return Analyzer(lambda text: analysis.tokens(text, words), lambda text: analysis.analyze(text, cut))


def rewrite(question: str, analyzer: Analyzer = LATIN, known_stop: frozenset[str] = frozenset("a an and are for in is of on or the to what when where who why how with".split())) -> SearchQuery:
    """The offline query rewriter: quoted parts are exact, other terms required unless very common."""
    exact = tuple(x.strip() for x in re.findall(r'"([^"]+)"', question) if x.strip())
    days = re.search(r"last (\d+) days", question.lower())
    rest = re.sub(r'"[^"]*"|last \d+ days', " ", question, flags=re.I)
    words = {t: w in known_stop for w in rest.lower().split() for t in analyzer.query(w)}
    return SearchQuery(
        exact=exact, required=tuple(t for t, common in words.items() if not common), optional=tuple(t for t, common in words.items() if common),
        original=question, last_n_days=int(days[1]) if days else 0,
    )


def queries_of(response: str, original: str) -> list[str]:
    """Several queries from a rewriter's lines: trimmed, blanks dropped, the original first."""
    return list(dict.fromkeys([original, *(x.strip() for x in response.split("\n") if x.strip())]))


# -- scoring ----------------------------------------------------------------------------------


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return F.when(tf > 0, tf / (tf + K1 * (1 - B + B * dl / avgdl))).otherwise(0.0)


def count_in(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def positions_in(tokens: Column, term: str) -> Column:
    return F.filter(F.transform(tokens, lambda x, k: F.when(x == term, k)), lambda p: p.isNotNull())


def phrase_frequency(positions: list[str], slop: int = SLOP) -> Column:
    """Sloppy frequency of a phrase from its terms' position columns, in any order.

    A position less its place in the phrase is the same for all terms of an exact match; a window is
    where every term has one, its moves the width. Each start counts once, with its narrowest window
    of at most `slop` moves, as 1 / (1 + moves). A place in the text serves one place of the phrase.
    """
    m = len(positions)
    events = ", ".join(f"transform({c}, p -> named_struct('at', p - {k}, 'slot', {k}))" for k, c in enumerate(positions))
    lo = "array_min(u.last)"
    hit = f"NOT exists(u.last, x -> x IS NULL) AND e.at - {lo} <= {slop} AND {lo} > s.lo AND size(array_distinct(transform(u.last, (x, i) -> x + i))) = {m}"
    after = f"named_struct('last', u.last, 'lo', IF({hit}, {lo}, s.lo), 'freq', s.freq + IF({hit}, 1D / (1 + e.at - {lo}), 0D))"
    step = f"transform(array(named_struct('last', transform(s.last, (x, i) -> IF(i = e.slot, e.at, x)))), u -> {after})[0]"
    start = f"named_struct('last', transform(sequence(1, {m}), x -> cast(NULL AS int)), 'lo', -1000000, 'freq', 0D)"
    return F.expr(f"aggregate(array_sort(concat({events})), {start}, (s, e) -> {step}, s -> s.freq)")


def with_terms(docs: DataFrame, terms: list[str], text_col: str = "text", positions: bool = False, analyzer: Analyzer = LATIN) -> DataFrame:
    """docs without the text, with dl and for each term k tf_k and, if asked, its positions pos_k."""
    rows = docs.withColumn("__t", analyzer.column(F.col(text_col)))
    keep = [c for c in docs.columns if c != text_col]
    if not positions:
        return rows.select(*keep, F.size("__t").alias("dl"), *(count_in(F.col("__t"), t).alias(f"tf_{k}") for k, t in enumerate(terms)))
    rows = rows.select(*keep, F.size("__t").alias("dl"), *(positions_in(F.col("__t"), t).alias(f"pos_{k}") for k, t in enumerate(terms)))
    return rows.select("*", *(F.size(f"pos_{k}").alias(f"tf_{k}") for k in range(len(terms))))


def document_counts(counted: DataFrame, terms: int) -> DataFrame:
    """One row: a df column a term."""
    return counted.agg(*(F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(terms)))


def statistics(counted: DataFrame, terms: int) -> DataFrame:
    """One row: n, avgdl, and a df column a term."""
    return counted.agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1e-9)).alias("avgdl"), *(F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(terms))
    )


def _term_score(k: int) -> Column:
    return idf(F.col("n"), F.col(f"df_{k}")) * weight(F.col(f"tf_{k}"), F.col("dl"), F.col("avgdl"))


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def bm25(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with score; documents that hold no term are left out."""
    counted = with_terms(docs, terms, text_col=text_col)
    scored = counted.join(F.broadcast(statistics(counted, len(terms))))  # one row
    keep = [c for c in docs.columns if c != text_col]
    return scored.select(*keep, _sum([_term_score(k) for k in range(len(terms))]).alias("score")).filter("score > 0")


def dismax(clauses: list[Column], tie: float = TIE) -> Column:
    """The best clause, and a share of the others."""
    top = F.greatest(*clauses) if len(clauses) > 1 else clauses[0]
    return top + tie * (_sum(clauses) - top)


def scored(counted: DataFrame, sized: DataFrame, query: SearchQuery, analyzer: Analyzer = LATIN) -> DataFrame:
    """counted rows (tf_k, pos_k of query.terms()) with score, those above 0: the dismax of the boosted clauses."""
    at = {t: k for k, t in enumerate(query.terms(analyzer))}
    rows = counted.join(F.broadcast(sized))  # one row
    clauses = []
    for p in query.phrases(analyzer):
        rarity = _sum([idf(F.col("n"), F.col(f"df_{at[t]}")) for t in p])
        clauses.append(query.boosts["phrase"] * rarity * weight(phrase_frequency([f"pos_{at[t]}" for t in p]), F.col("dl"), F.col("avgdl")))
    for name, own in (("required", query.required), ("optional", query.optional)):
        if own:
            clauses.append(query.boosts[name] * _sum([_term_score(at[t]) for t in own]))
    return rows.withColumn("score", dismax(clauses)).filter("score > 0")


def restricted(hits: DataFrame, query: SearchQuery) -> DataFrame:
    """hits (file_path, create_time, score) under the query's prefix and of its days; each restriction met adds 1 to the score."""
    if query.path_prefix:
        hits = hits.filter(catalog.under(F.col("file_path"), query.path_prefix)).withColumn("score", F.col("score") + 1)
    if query.last_n_days > 0:
        hits = hits.filter(catalog.recent(F.col("create_time"), F.to_timestamp(F.lit(query.as_of)), query.last_n_days)).withColumn("score", F.col("score") + 1)
    return hits


def strategy(docs: DataFrame, query: SearchQuery, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer = LATIN) -> DataFrame:
    """Documents with score: the dismax of boosted phrase, required and optional clauses, within prefix and days.

    Required and optional terms are looked up as they stand, phrases are analysed. Statistics are the collection's.
    """
    terms = query.terms(analyzer)
    if not terms:
        return docs.drop(text_col).withColumn("score", F.lit(0.0)).limit(0)
    counted = with_terms(docs, terms, text_col, bool(query.exact), analyzer)
    hits = scored(counted, statistics(counted, len(terms)), query, analyzer)
    return restricted(hits, query).select(*(c for c in docs.columns if c != text_col), "score")


def top(hits: DataFrame, n: int, id_col: str = "doc_id", by_time: bool = False) -> DataFrame:
    """(rank, ...) of the best n, by score or, newest first, by create_time."""
    order = [F.desc("create_time"), F.col(id_col)] if by_time else [F.desc("score"), F.col(id_col)]
    best = hits.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


class Source(Protocol):
    """Postings to search in: an index, or Scan over texts."""

    #: Whether near() gives only terms that documents hold.
    exact_dictionary: bool

    def of_terms(self, terms: list[str]) -> DataFrame: ...

    def near(self, term: str, edits: int) -> DataFrame: ...

    def with_prefix(self, prefix: str) -> DataFrame: ...

    def sized(self) -> DataFrame: ...


class Scan:
    """A Source over texts: terms are picked within the rows, at each lookup."""

    exact_dictionary = True

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer = LATIN):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.analyzer = analyzer
        self.tokens = analyzer.column(F.col("text"))

    def of_terms(self, terms: list[str]) -> DataFrame:
        from . import index

        if not terms:
            return self.docs.sparkSession.createDataFrame([], "doc_id long, term string, tf int, dl int, positions array<int>")
        return index.postings(self.docs, terms=terms, tokens=self.analyzer.column)

    def near(self, term: str, edits: int) -> DataFrame:
        d = F.levenshtein("term", F.lit(term), edits)
        # lengths that are further apart can't be within the edits
        fits = lambda x: F.length(x).between(len(term) - edits, len(term) + edits)
        rows = self.docs.select(F.explode(F.array_distinct(F.filter(self.tokens, fits))).alias("term")).distinct()
        return rows.select(d.alias("d"), "term").filter("d >= 0")

    def with_prefix(self, prefix: str) -> DataFrame:
        return self.docs.filter(F.exists(self.tokens, lambda x: x.startswith(prefix))).select("doc_id")

    def sized(self) -> DataFrame:
        return self.docs.select(F.size(self.tokens).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(0.0)), F.lit(1e-9)).alias("avgdl"))


class Clause(NamedTuple):
    #: term, fuzzy, phrase or prefix.
    kind: str
    terms: tuple[str, ...]
    #: 1 must match, 0 may, -1 must not.
    occurs: int = 0
    slop: int = 0


def parsed_fallback(query: str | None, analyzer: Analyzer = LATIN) -> list[Clause] | None:
    """The clauses of a plain query: terms, "phrases", prefixes*, AND, OR, NOT, the last word fuzzy; None if it can't be read.

    Commas and full stops part words. Quotes must be paired; AND, OR and NOT need what they join.
    """
    cleaned = re.sub(r"[,.]+", " ", query or "").strip()
    if not cleaned or cleaned.count('"') % 2:
        return None
    words = re.findall(r'"[^"]*"|[^\s"]+', cleaned)
    if words[0] in ("AND", "OR") or words[-1] in ("AND", "OR", "NOT"):
        return None
    out: list[list[Clause]] = []
    joined, negated = False, False
    for k, word in enumerate(words):
        if word in ("AND", "OR", "NOT"):
            if k and words[k - 1] in ("AND", "OR", "NOT") and word != "NOT":
                return None
            if word == "AND":
                joined = True
                if out:
                    out[-1] = [c._replace(occurs=c.occurs or 1) for c in out[-1]]
            negated = word == "NOT"
            continue
        last = k == len(words) - 1
        terms = tuple(analyzer.query(word))
        if word.startswith('"'):
            got = [Clause("phrase", terms, slop=SLOP if last else 0)] if terms else []
        elif re.fullmatch(r"[^*]+\*", word):
            got = [Clause("prefix", (word[:-1].lower(),))]
        else:
            got = [Clause("fuzzy" if last and t == terms[-1] and i == len(terms) - 1 else "term", (t,)) for i, t in enumerate(terms)]
        occurs = -1 if negated else 1 if joined else 0
        out.append([c._replace(occurs=occurs) for c in got])
        joined = negated = False
    return [c for group in out for c in group]


def expansions(source: Source, term: str, edits: int = EDITS, most: int = EXPANSIONS) -> dict[str, float]:
    """The nearest terms that documents hold, by distance, then name, with 1 - distance / the shorter length."""
    order, found, at = source.near(term, edits).orderBy("d", "term"), {}, 0
    share = lambda r: max(0.0, 1 - r["d"] / min(len(r["term"]), len(term)))
    if source.exact_dictionary:
        return {r["term"]: share(r) for r in order.limit(most).collect()}
    while len(found) < most:
        some = order.offset(at).limit(CANDIDATES).collect()
        held = {r["term"] for r in source.of_terms([r["term"] for r in some]).select("term").distinct().collect()} if some else set()
        for r in some:
            if r["term"] in held and len(found) < most:
                found[r["term"]] = share(r)
        if len(some) < CANDIDATES:
            break
        at += CANDIDATES
    return found


def fallback(source: Source, query: str | None, analyzer: Analyzer = LATIN) -> DataFrame:
    """(doc_id, score) of a plain query (parsed_fallback): the sum of the clauses that match, if those that must do.

    A fuzzy term stands for the terms within EDITS edits that documents hold, each counted by its
    nearness; a prefix scores 1; a query that can't be read finds nothing.
    """
    clauses = parsed_fallback(query, analyzer)
    sized = source.sized()
    nothing = sized.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    if not clauses:
        return nothing
    shares = [{c.terms[0]: 1.0} if c.kind == "term" else expansions(source, c.terms[0]) if c.kind == "fuzzy" else {} for c in clauses]
    rows = [(k, t, share) for k, own in enumerate(shares) for t, share in own.items()]
    wanted = sorted({t for _, t, _ in rows} | {t for c in clauses if c.kind == "phrase" for t in c.terms})
    parts = []
    held = source.of_terms(wanted)
    if rows:
        spark = sized.sparkSession
        used = spark.createDataFrame(rows, "clause int, term string, share double")
        df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # the query's terms; one row
        hits = held.join(F.broadcast(used), "term").join(F.broadcast(df), "term").join(F.broadcast(sized))
        one = F.col("share") * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
        parts.append(hits.groupBy("doc_id", "clause").agg(F.sum(one).alias("score")))
    for k, c in enumerate(clauses):
        if c.kind == "prefix":
            parts.append(source.with_prefix(c.terms[0]).select("doc_id", F.lit(k).alias("clause"), F.lit(1.0).alias("score")))
        elif c.kind == "phrase":
            own = list(dict.fromkeys(c.terms))
            grouped = held.filter(F.col("term").isin(own)).groupBy("doc_id").agg(
                F.max("dl").alias("dl"), *(F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"pos_{j}") for j, t in enumerate(own))
            )
            counted = grouped.select("doc_id", "dl", *(F.size(f"pos_{j}").alias(f"tf_{j}") for j in range(len(own))), *(f"pos_{j}" for j in range(len(own))))
            rarity = _sum([idf(F.col("n"), F.col(f"df_{own.index(t)}")) for t in c.terms])
            frequency = phrase_frequency([f"pos_{own.index(t)}" for t in c.terms], c.slop)
            hits = counted.join(F.broadcast(document_counts(counted, len(own)))).join(F.broadcast(sized))  # one row each
            parts.append(hits.select("doc_id", F.lit(k).alias("clause"), (rarity * weight(frequency, F.col("dl"), F.col("avgdl"))).alias("score")).filter("score > 0"))
    if not parts:
        return nothing
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    must = [k for k, c in enumerate(clauses) if c.occurs == 1]
    never = [k for k, c in enumerate(clauses) if c.occurs == -1]
    met = total.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("clause").isin(never), F.col("score")).otherwise(0.0)).alias("score"),
        F.count_if(F.col("clause").isin(must)).alias("must"), F.count_if(F.col("clause").isin(never)).alias("never"),
    )
    return met.filter((F.col("must") == len(must)) & (F.col("never") == 0) & (F.col("score") > 0)).select("doc_id", "score")


def fuzzy(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The plain query over texts: see fallback."""
    return fallback(Scan(docs, id_col, text_col), query)


def bag_union(results: list[DataFrame]) -> DataFrame:
    """Results of several queries one behind the other, repeated hits included."""
    out = results[0].withColumn("q", F.lit(0))
    for k, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("q", F.lit(k)))
    return out


def top_up(first: DataFrame, second: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first list, filled to n from the second, each id once."""
    rows = first.select(id_col, "score", F.lit(0).alias("part")).unionByName(second.select(id_col, "score", F.lit(1).alias("part")))
    best = rows.groupBy(id_col).agg(F.min(F.struct("part", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(id_col, F.col("b.part").alias("part"), (-F.col("b.s")).alias("score")).orderBy("part", F.desc("score"), id_col).limit(n)


def quota(hits: DataFrame, queries: int, total: int) -> DataFrame:
    """Results of several queries (q, pos, title, ...): a title's first hit, ceil(total / queries) a query, total in all."""
    first = F.row_number().over(Window.partitionBy("title").orderBy("q", "pos"))
    kept = hits.withColumn("k", first).filter("k = 1")
    share = F.row_number().over(Window.partitionBy("q").orderBy("pos"))
    return kept.withColumn("k", share).filter(F.col("k") <= -(-total // queries)).drop("k").orderBy("q", "pos").limit(total)


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__k", k).filter("__k = 1").drop("__k")


def rerank(hits: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """hits in the order of a reranker's id list (one row, column ids); unknown and unlisted ids go."""
    order = ids.select(F.posexplode("ids").alias("pos", id_col)).groupBy(id_col).agg(F.min("pos").alias("pos"))
    return hits.join(bounded.broadcast(order), id_col).orderBy("pos")


def snippets(hits: DataFrame, terms: list[str], text_col: str = "text", size: int = 300, tag: str = "B", missing: str = "No match found") -> DataFrame:
    """hits with snippet: the fragment with the most matches, matches in tags."""
    pattern = "|".join(re.escape(t) for t in terms)
    best = tx.best_fragment(F.col(text_col), pattern, size)
    return hits.withColumn("__f", best).withColumn(
        "snippet", F.when(F.col("__f.hits") > 0, tx.highlight(F.col("__f.fragment"), pattern, tag)).otherwise(missing)
    ).drop("__f")


def answers(hits: DataFrame, paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (rank, para_id, score) with content, title and url; absent parts are null, url is named missing."""
    rows = hits.join(paragraphs.select("para_id", "doc_id", "content"), "para_id", "left")
    rows = rows.join(documents.select(F.col("id").alias("doc_id"), F.col("file_name").alias("title"), F.col("file_path").alias("path")), "doc_id", "left")
    return rows.select("rank", "para_id", "score", "title", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("path", F.lit("URL not found")).alias("url")).orderBy("rank")


def with_dice(rows: DataFrame, left: Column, right: Column, name: str) -> DataFrame:
    """rows with the Dice similarity of two texts, right being the shorter."""
    return rows.withColumns({"__l": tx.bare(left), "__r": tx.bare(right)}).withColumn(name, tx.dice(F.col("__l"), F.col("__r"))).drop("__l", "__r")


def similar_questions(questions: DataFrame, asked: str, least: float = 0.7) -> DataFrame:
    """questions (id, question) with similarity of at least `least`, most alike first."""
    scored = with_dice(questions, F.lower("question"), F.lit(asked.lower()), "similarity")
    return scored.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id")


def best_section(sections: DataFrame, key: str, wanted: Column, title: Column | None = None) -> DataFrame:
    """Per key the section (ord, content) most like `wanted`, or like the title where that is empty; the first of equals, none if all are 0."""
    text = wanted if title is None else F.when(F.trim(F.coalesce(wanted, F.lit(""))) != "", wanted).otherwise(title)
    scored = with_dice(sections, F.col("content"), text, "score").filter("score > 0")
    best = scored.groupBy(key).agg(F.max_by(F.struct("ord", "content", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select(key, "b.ord", "b.content", "b.score")
