"""Facts for questions: extraction from paragraph batches, grouping, standing tasks kept up to date.

The extractor is pluggable. The default needs no network: it takes the sentences that share the
largest part of the question's terms, which makes every plan here deterministic.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import bounded, catalog, chunk

#: (batch of (id, content), question) to a response text holding JSON {"answer": [{"fact": ..., "id": ...}]}.
Extractor = Callable[[list[tuple[int, str]], str], str]
OVERLAP, ATTEMPTS = 0.5, 3
#: Batches of a group, about, that one task folds.
BATCHES = 64
PENDING, PROCESSING, ACTIVE, FAILED = "pending", "processing", "active", "failed"


def sentences(content: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def overlap(sentence: Column, terms: Column) -> Column:
    """The share of the question's distinct terms that the sentence holds."""
    wanted = F.array_distinct(terms)
    shared = F.size(F.array_intersect(wanted, tx.tokens(sentence)))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(0.0)


def extract(paragraphs: DataFrame, question: Column, least: float = OVERLAP) -> DataFrame:
    """(columns of paragraphs but content, seq, fact): sentences that hold `least` of the question's terms."""
    keep = [F.col(c) for c in paragraphs.columns if c != "content"]
    rows = paragraphs.select(*keep, F.posexplode(sentences(F.col("content"))).alias("seq", "fact"))
    return rows.filter(overlap(F.col("fact"), tx.tokens(question)) >= least)


def spread(rows: DataFrame, size: Column, cap: int) -> DataFrame:
    """rows with g: groups by hash of para_id that hold about BATCHES batches of `cap` characters, whatever all rows come to."""
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 0
    return rows.withColumn("g", F.pmod(F.xxhash64("para_id"), F.lit(max(1, -(-total // (max(cap, 1_000) * BATCHES))))).cast("int"))


def batched(rows: DataFrame, keys: list[str], cap: int = chunk.BATCH) -> DataFrame:
    """(keys, g, batch, rows ARRAY<STRUCT<id, content>>): paragraphs (keys, para_id, content) in batches of at most `cap` characters, one each if cap is 0."""
    size = F.length("content").cast("long")
    own = spread(rows, size, cap).select(F.struct(*keys, "g").alias("k"), "para_id", "content", size.alias("size"))
    each = chunk.batches(own, "k", "para_id", "size", cap)
    pair = F.struct(F.col("para_id").alias("id"), "content")
    return each.groupBy("k", "batch").agg(F.array_sort(F.collect_list(pair)).alias("rows")).select("k.*", "batch", "rows")


def extract_with(extractor: Extractor, batches: DataFrame, question: str | None = None, attempts: int = ATTEMPTS, delay: float = 1.0) -> DataFrame:
    """batches' columns but rows, with response, cost, attempts and error, by an external extractor; a failing batch is a row like others.

    batches: rows ARRAY<STRUCT<id, content>>, batch, other columns, and key_question unless a question is given.
    A call that fails, or answers without a bracket, is tried again after `delay` seconds, then twice that; the last error becomes a column.
    cost is characters sent and received, of every attempt that was answered.
    """
    if question is not None:
        batches = batches.withColumn("key_question", F.lit(question))
    keep = [c for c in batches.columns if c != "rows" and (c != "key_question" or question is None)]
    kinds = dict(batches.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for asked, rows in zip(frame["key_question"], frame["rows"]):
                sent = [(int(r["id"]), r["content"]) for r in rows]
                response, error, cost, tries = "", None, 0, 0
                while tries < attempts:
                    if tries:
                        time.sleep(delay * tries)
                    tries += 1
                    try:
                        response, error = extractor(sent, asked), None
                    except Exception as e:  # the service's failure, kept as a column after the last attempt
                        response, error = "", f"{type(e).__name__}: {e}"[:500]
                        continue
                    cost += sum(len(c) for _, c in sent) + len(asked) + len(response)
                    if "{" in response or "[" in response:
                        break
                out.append((response, cost, tries, error))
            yield pd.concat([frame[keep].reset_index(drop=True), pd.DataFrame(out, columns=["response", "cost", "attempts", "error"])], axis=1)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "response string, cost long, attempts int, error string"])
    return batches.mapInPandas(run, schema)


def parsed(responses: DataFrame) -> DataFrame:
    """responses' columns but response, cost, attempts and error, with seq, para_id, fact; facts without an id are dropped."""
    keep = [c for c in responses.columns if c not in ("response", "cost", "attempts", "error")]
    rows = responses.select(*keep, F.posexplode(tx.parsed_facts(F.col("response"))).alias("seq", "x"))
    return rows.select(*keep, "seq", F.col("x.id").alias("para_id"), F.col("x.fact").alias("fact")).filter("para_id IS NOT NULL")


def valid(facts: DataFrame) -> DataFrame:
    """Facts (fact, url) that have both."""
    return facts.filter("fact IS NOT NULL AND trim(fact) <> '' AND url IS NOT NULL AND url <> ''")


def single_batches(paragraphs: DataFrame, group: str, order: str) -> DataFrame:
    """A batch for each paragraph, numbered from 1 within its group."""
    return paragraphs.withColumn("batch", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def unfinished(paragraphs: DataFrame, checkpoint: int | None) -> DataFrame:
    """Paragraphs after a task's checkpoint."""
    return paragraphs if checkpoint is None else paragraphs.filter(F.col("para_id") > checkpoint)


def by_paragraph(facts: DataFrame, key: str = "para_id", order: str = "seq") -> DataFrame:
    """(key, facts): a paragraph's facts joined by line feeds, paragraphs without any left out."""
    rows = facts.filter("fact IS NOT NULL AND trim(fact) <> ''")
    ordered = F.array_sort(F.collect_list(F.struct(order, "fact")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["fact"]), "\n").alias("facts")).orderBy(key)


def of_similar(facts: DataFrame, paragraphs: DataFrame, documents: DataFrame, tasks: DataFrame, prefix: str) -> DataFrame:
    """Stored facts of similar tasks below a prefix: a paragraph's first fact, by task order.

    tasks: task_id, pos (order of likeness).
    """
    rows = facts.join(bounded.broadcast(tasks), "task_id").join(paragraphs.select("para_id", "doc_id"), "para_id")
    rows = rows.join(documents.filter(catalog.under(F.col("file_path"), prefix)).select("doc_id", "file_path"), "doc_id")
    first = rows.groupBy("para_id").agg(F.min(F.struct("pos", "task_id", "fact", "file_path")).alias("x"))
    return first.select("para_id", "x.task_id", "x.fact", "x.file_path").orderBy("para_id")


def hits_by_task(used: DataFrame, tasks: DataFrame) -> DataFrame:
    """tasks with hit_count raised by the rows of `used` (task_id)."""
    more = used.groupBy(F.col("task_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    return tasks.join(more, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__n")


def token_cost(calls: DataFrame) -> DataFrame:
    """(task_id, cost): characters of prompts and responses."""
    return calls.groupBy("task_id").agg(F.sum(F.length("prompt") + F.length("response")).alias("cost"))


def cost_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(task_id, cost): characters of the paragraphs asked about, of the question each time, and of the facts found."""
    sent = rows.groupBy("task_id").agg(F.sum(F.length("content") + F.length("key_question")).alias("sent"))
    got = found.groupBy("task_id").agg(F.sum(F.length("fact")).alias("got"))
    return sent.join(got, "task_id", "left").select("task_id", (F.col("sent") + F.coalesce("got", F.lit(0))).cast("long").alias("cost"))


def paragraphs_of_task(facts: DataFrame, task_id: int) -> DataFrame:
    """The distinct paragraphs with facts of a task."""
    return facts.filter(F.col("task_id") == task_id).select("para_id").distinct()


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


def paragraphs_by_task(facts: DataFrame) -> DataFrame:
    return facts.groupBy("task_id").agg(F.countDistinct("para_id").alias("paragraphs"))


# -- incremental maintenance ------------------------------------------------------------------


def affected(changed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(doc_id, task_id) of changed documents (doc_id, file_path) and the tasks above them."""
    return catalog.tasks_for_paths(changed, tasks).join(changed.select("doc_id", "file_path"), "file_path").select("doc_id", "task_id")


def maintain(facts: DataFrame, pairs: DataFrame, fresh: DataFrame) -> DataFrame:
    """facts (task_id, doc_id, para_id, fact) with those of the affected pairs replaced by fresh ones."""
    return facts.join(pairs, ["task_id", "doc_id"], "left_anti").unionByName(fresh)


def refresh(tasks: DataFrame, paragraphs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(task_id, doc_id, para_id, seq, fact) of all tasks over the paragraphs below their directories.

    paragraphs: doc_id, file_path, para_id, content. done: (task_id, para_id) already extracted, so a
    run that was cut short goes on where it stopped.
    """
    own = catalog.tasks_for_paths(paragraphs.select("file_path").distinct(), tasks)
    pairs = paragraphs.join(own, "file_path").join(bounded.broadcast(tasks.select(F.col("id").alias("task_id"), "key_question")), "task_id")
    if done is not None:
        pairs = pairs.join(done, ["task_id", "para_id"], "left_anti")
    return extract(pairs, F.col("key_question")).select("task_id", "doc_id", "para_id", "seq", "fact")


def settle(tasks: DataFrame, outcome: DataFrame) -> DataFrame:
    """pending, processing and failed tasks become active, or failed where outcome (id, error) has an error."""
    both = tasks.join(outcome.select("id", F.coalesce("error", F.lit("")).alias("__e")), "id", "left")
    open_ = F.col("status").isin(PENDING, PROCESSING, FAILED) & F.col("__e").isNotNull()
    status = F.when(open_, F.when(F.col("__e") == "", ACTIVE).otherwise(FAILED)).otherwise(F.col("status"))
    return both.withColumn("status", status).drop("__e")


def length_of(facts: DataFrame, budget: int = chunk.BATCH) -> DataFrame:
    """One row: the facts' total length and whether it is within the budget."""
    return facts.agg(F.coalesce(F.sum(F.length("fact")), F.lit(0)).alias("total")).withColumn("within", F.col("total") <= budget)


def reduce_facts(facts: DataFrame, refine: Callable[[DataFrame], DataFrame], budget: int = chunk.BATCH, rounds: int = 3, written: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Facts (para_id, seq, fact) refined batch by batch until their length is within budget, at most `rounds` times.

    refine: batches (g, batch, para_id, seq, fact) to (para_id, seq, fact). Facts are spread over groups by paragraph, so
    a round is as many tasks as the facts need. written keeps a round's facts, so that a model is asked once.
    """
    for _ in range(rounds):
        if length_of(facts, budget).first()["within"]:
            break
        size = F.length("fact").cast("long")
        own = spread(facts, size, budget).select("g", F.struct("para_id", "seq").alias("o"), "fact", size.alias("size"))
        batches = chunk.batches(own, "g", "o", "size", budget, sep=1)
        facts = written(refine(batches.select("g", "batch", "o.para_id", "o.seq", "fact")))
    return facts


def result_list(facts: DataFrame) -> DataFrame:
    """One row: numbered facts with their sources, a line each."""
    line = F.format_string("%d. %s (%s)", "seq", "fact", "url")
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return facts.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("results"), F.sort_array(F.collect_set("url")).alias("urls"))
