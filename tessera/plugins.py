"""Pluggable parts: language-model clients, rewriters, rerankers, index handlers; none needs a network by default."""

from __future__ import annotations

import json
import re
import threading
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import search


class LanguageModel(Protocol):
    """A prompt to a response text."""

    def complete(self, prompt: str) -> str: ...


@dataclass
class Throttled:
    """A model with bounded concurrency, tried `attempts` times with linearly growing delays."""

    model: LanguageModel
    concurrency: int = 5
    attempts: int = 3
    delay: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    _slots: threading.Semaphore = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._slots = threading.Semaphore(self.concurrency)

    def __getstate__(self) -> dict:
        """Sent to a task without its slots; each process has its own."""
        return {k: v for k, v in self.__dict__.items() if k != "_slots"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def complete(self, prompt: str) -> str:
        with self._slots:
            for k in range(1, self.attempts + 1):
                try:
                    return self.model.complete(prompt)
                except Exception:  # the service's failure; the last one is raised
                    if k == self.attempts:
                        raise
                    self.sleep(self.delay * k)
        raise AssertionError("attempts must be positive")


def extractor_of(model: LanguageModel) -> Callable[[list[tuple[int, str]], str], str]:
    """A model as an extractor of facts (facts.extract_with): paragraphs as JSON, and the question."""

    def extract(batch: list[tuple[int, str]], question: str) -> str:
        listed = json.dumps([{"id": i, "content": c} for i, c in batch], ensure_ascii=False)
        return model.complete(f'List the facts in these paragraphs that answer: {question}\nAnswer with JSON {{"answer": [{{"fact": "...", "id": 1}}]}}, id being the paragraph\'s.\n{listed}')

    return extract


def refiner_of(model: LanguageModel) -> Callable[[list[tuple[int, str]], str], str]:
    """A model that says facts more briefly, as an extractor over facts."""

    def refine(batch: list[tuple[int, str]], question: str) -> str:
        listed = json.dumps([{"id": i, "fact": c} for i, c in batch], ensure_ascii=False)
        return model.complete(f'Put these facts together, in fewer words, as an answer to: {question}\nAnswer with JSON {{"answer": [{{"fact": "...", "id": 1}}]}}, id being that of a fact used.\n{listed}')

    return refine


def rewrite_with(model: LanguageModel, question: str, analyzer: search.Analyzer = search.LATIN) -> search.SearchQuery:
    """A model's query {lastNDays, required, optional, exact} read from its JSON; the offline rewriter on any failure."""
    offline = search.rewrite(question, analyzer)
    try:
        found = re.search(r"\{.*\}", model.complete(question), re.S)
        got = json.loads(found[0])
        words = lambda k: tuple(str(x) for x in got.get(k) or ())
        query = search.SearchQuery(words("exact"), words("required"), words("optional"), question, last_n_days=int(got.get("lastNDays") or 0))
    except Exception:  # whatever the model answered, a question can be searched
        return offline
    return query if query.exact or query.required or query.optional else offline


def queries_with(model: LanguageModel, question: str, most: int = 5) -> list[str]:
    """The question and a model's other ways to ask it, a line each, at most `most` in all; the question alone if it fails."""
    try:
        said = model.complete(f"Write up to {most - 1} search queries, a line each, that help to answer: {question}")
    except Exception:  # whatever the model answered, the question can be searched
        said = ""
    return search.queries_of(said, question)[:most]


def quoted(terms: Column) -> Column:
    """Terms in double quotes, joined by blanks."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def unquoted(terms: Column) -> Column:
    """Terms joined by blanks."""
    return F.array_join(terms, " ")


def _answer(model: LanguageModel, prompt: str, pattern: str, attempts: int = 3) -> Any:
    """JSON in a model's answer, asked for up to `attempts` times; None if none can be read."""
    for _ in range(attempts):
        try:
            return json.loads(re.search(pattern, model.complete(prompt), re.S)[0])
        except Exception:  # the service's failure or an unreadable answer; asked again
            continue
    return None


def rerank_with(model: LanguageModel, hits: DataFrame, question: str, id_col: str = "doc_id", text_col: str = "content", most: int = 100, chars: int = 500) -> DataFrame:
    """One row with ids in a model's order, asked up to three times; the order of the hits if it fails.

    The prompt holds the first `chars` characters of the first `most` hits; the others follow in their order.
    """
    rows = hits.orderBy("rank").select(id_col, F.substring(text_col, 1, chars).alias("text")).collect()  # a result list
    listed = "\n".join(f"{r[id_col]}: {r['text']}" for r in rows[:most])
    got = _answer(model, f"Order these texts by how well they answer: {question}\nAnswer with a JSON list of their numbers.\n{listed}", r"\[[\d\s,\"-]*\]")
    ids = [*map(int, got or [r[id_col] for r in rows[:most]]), *(int(r[id_col]) for r in rows[most:])]
    return hits.sparkSession.createDataFrame([(ids,)], "ids array<long>")


def similar_with(model: LanguageModel, questions: DataFrame, asked: str, least: float = 0.7, page: int = 1_000) -> DataFrame:
    """questions (id, question) that a model finds alike, with similarity from 0 to 1, most alike first; it is asked about `page` of them at a time.

    A page that it fails on is measured offline.
    """
    scores: list[tuple[int, float]] = []
    offline: list[int] = []

    def ask(rows: list) -> None:
        listed = "\n".join(f"{r['id']}: {r['question']}" for r in rows)
        got = _answer(model, f'Which of these questions ask the same as: {asked}\nAnswer with JSON [{{"id": 1, "similarity": 0 to 100}}].\n{listed}', r"\[.*\]")
        if got is None:
            offline.extend(r["id"] for r in rows)
        else:
            scores.extend((int(x["id"]), float(x["similarity"]) / 100) for x in got if isinstance(x, dict) and "id" in x and "similarity" in x)

    rows = []
    for row in questions.select("id", "question").orderBy("id").toLocalIterator():
        rows.append(row)
        if len(rows) == page:
            ask(rows)
            rows = []
    if rows:
        ask(rows)
    spark = questions.sparkSession
    said = spark.createDataFrame(scores, "id long, similarity double").filter(F.col("similarity") > least)
    found = questions.join(said, "id")
    if offline:
        rest = questions.join(spark.createDataFrame([(i,) for i in offline], "id long"), "id", "left_semi")
        found = found.unionByName(search.similar_questions(rest, asked, least).select(found.columns))
    return found.orderBy(F.desc("similarity"), "id")


def overlap_rerank(hits: DataFrame, question: str, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """The offline reranker: one row with ids by the share of the question's terms, then rank."""
    wanted = F.array(*map(F.lit, dict.fromkeys(search.analyze(question))))
    share = F.size(F.array_intersect(wanted, tx.tokens(F.col(text_col))))
    ordered = F.array_sort(F.collect_list(F.struct((-share).alias("s"), "rank", id_col)))
    return hits.agg(F.transform(ordered, lambda x: x[id_col]).alias("ids"))


@runtime_checkable
class IndexHandler(Protocol):
    """What a search back end offers to the engine."""

    def rewrite(self, question: str) -> search.SearchQuery: ...

    def search(self, query: search.SearchQuery) -> DataFrame: ...

    def rerank(self, hits: DataFrame, question: str) -> DataFrame: ...

    def content(self, hits: DataFrame) -> DataFrame: ...

    def paths(self) -> DataFrame: ...

    def collect_facts(self, question: str, path: str) -> DataFrame: ...


@dataclass
class Registry:
    """Handlers by path prefix; the longest prefix of a path serves it. Code is registered, never evaluated."""

    handlers: dict[str, IndexHandler] = field(default_factory=dict)
    default: IndexHandler | None = None

    def register(self, prefix: str, handler: IndexHandler) -> None:
        missing = [m for m in ("rewrite", "search", "rerank", "content", "paths", "collect_facts") if not callable(getattr(handler, m, None))]
        if missing:
            raise TypeError(f"the handler lacks {', '.join(missing)}")
        self.handlers[prefix] = handler

    def of(self, path: str) -> IndexHandler | None:
        found = max((p for p in self.handlers if path.startswith(p)), key=len, default=None)
        return self.handlers[found] if found is not None else self.default

    def of_all(self, path: str) -> list[IndexHandler]:
        """All handlers whose prefix the path starts, or that starts the path, longest prefix first."""
        found = sorted((p for p in self.handlers if p.startswith(path) or path.startswith(p)), key=lambda p: (-len(p), p))
        return [self.handlers[p] for p in found]


@dataclass
class Templates:
    """Handlers made from named templates and configured instances; code is registered, never evaluated.

    instances: (path_prefix, template_id, config), config being JSON. One of an unknown template, or
    whose handler lacks a method, is left out with a warning.
    """

    registry: Registry
    factories: dict[str, Callable[[dict], IndexHandler]] = field(default_factory=dict)

    def add(self, template_id: str, factory: Callable[[dict], IndexHandler]) -> None:
        self.factories[template_id] = factory

    def load(self, instances: DataFrame) -> list[str]:
        """Register the instances, all of them; the prefixes that were."""
        loaded = []
        for row in instances.select("path_prefix", "template_id", "config").orderBy("path_prefix").toLocalIterator():
            try:
                handler = self.factories[row["template_id"]](json.loads(row["config"] or "{}"))
                self.registry.register(row["path_prefix"], handler)
                loaded.append(row["path_prefix"])
            except (KeyError, TypeError, ValueError) as e:
                warnings.warn(f"{row['path_prefix']} is left out: {type(e).__name__} {e}", stacklevel=2)
        return loaded

    def remove(self, template_id: str, instances: DataFrame) -> bool:
        """Forget a template that no instance uses; whether it was forgotten."""
        if not instances.filter(F.col("template_id") == template_id).isEmpty():
            return False
        return self.factories.pop(template_id, None) is not None


class Expiring:
    """A value made anew when older than `seconds`."""

    def __init__(self, make: Callable[[], Any], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self._at, self._value = None, None

    def get(self) -> Any:
        if self._at is None or self.clock() - self._at >= self.seconds:
            self._value, self._at = self.make(), self.clock()
        return self._value

    def forget(self) -> None:
        self._at = None
