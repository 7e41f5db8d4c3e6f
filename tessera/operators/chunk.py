"""Heading-aware chunks of Markdown documents, row by row, and size-bounded batches.

A document of at most max_size characters is one chunk. A longer one is cut at its level-one
headings; a part still too long is cut at the next level, down to level LEVELS, then at fixed widths.
Neighbouring parts are put together again while they fit. The document's title (at most TITLE
characters) leads every chunk after the first. No text is lost: what would not fit goes to a further
chunk; empty chunks are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SIZE, LEVELS, TITLE, RESERVE, BATCH = 5000, 5, 30, 1000, 28720
#: Documents of a prompt.
DOCUMENTS = 10


def sections(content: str, level: int) -> list[str]:
    """Parts that each begin at a heading of this level (or at the start), their lines trimmed."""
    mark, parts = "#" * level + " ", [[]]
    for line in (x.strip() for x in content.split("\n")):
        if line.startswith(mark) and any(parts[-1]):
            parts.append([])
        parts[-1].append(line)
    return [p for p in ("\n".join(x) for x in parts) if p.strip()]


def document_title(content: str) -> str:
    lines = content.split("\n")
    found = next((x[2:] if x.startswith("# ") else x[1:] for x in lines if x.startswith("#")), None)
    return (found or next((x for x in lines if x.strip()), "")).strip()[:TITLE]


def _cut(content: str, size: int, level: int) -> list[str]:
    """Parts of at most `size` characters, at headings where there are any."""
    if len(content) <= size:
        return [content]
    if level > LEVELS:
        return [content[k : k + size] for k in range(0, len(content), size)]
    own = sections(content, level)
    parts = [p for s in own for p in ([s] if len(s) <= size else _cut(s, size, level + 1))]
    merged: list[str] = []
    for p in parts:
        if merged and len(merged[-1]) + 1 + len(p) <= size:
            merged[-1] += "\n" + p
        else:
            merged.append(p)
    return merged


def split_markdown(content: str | None, max_size: int = MAX_SIZE) -> list[str]:
    content = content or ""
    if len(content) <= max_size:
        return [content] if content.strip() else []
    title = document_title(content)
    lead = f"# {title}\n" if title else ""
    parts = _cut(content, max(1, max_size - min(RESERVE, len(lead))), 1)
    return [p if k == 0 else lead + p for k, p in enumerate(parts) if p.strip()]


def chunks(docs: DataFrame, max_size: int = MAX_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, content); short documents stay in the JVM, only long ones go through Python."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    short = F.length("text") <= max_size
    one = rows.filter(short & (F.trim("text") != "")).select("doc_id", F.lit(0).alias("ord"), F.col("text").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(i, k, c) for i, t in zip(batch["doc_id"], batch["text"]) for k, c in enumerate(split_markdown(t, max_size))]
            yield pd.DataFrame(got, columns=["doc_id", "ord", "content"])

    return one.unionByName(rows.filter(~short).mapInPandas(run, "doc_id long, ord int, content string"))


def starts_of(sizes: Column, cap: int, sep: int = 0, strict: bool = False) -> Column:
    """Where batches of consecutive items start, by a greedy fold over their sizes.

    An item joins the running batch if the total, with sep between items, stays within cap (below it
    if strict); an item larger than cap is a batch of its own and no batch is empty.
    """
    fits = lambda total: total < cap if strict else total <= cap
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("starts"))
    items = F.transform(sizes, lambda n, i: F.struct(n.alias("n"), i.alias("i")))

    def step(s: Column, x: Column) -> Column:
        joined = s["total"] + sep + x["n"]
        same = (x["i"] > 0) & fits(joined)
        return F.struct(F.when(same, joined).otherwise(x["n"]).cast("long").alias("total"), F.when(same, s["starts"]).otherwise(F.array_append(s["starts"], x["i"])).alias("starts"))

    return F.aggregate(items, start, step, lambda s: s["starts"])


def batches(items: DataFrame, group: str, order: str, size: str, cap: int = BATCH, sep: int = 0, strict: bool = False) -> DataFrame:
    """items with batch: a fold within each group; groups are independent tasks."""
    others = [c for c in items.columns if c != group]
    ordered = F.array_sort(F.collect_list(F.struct(order, size, *(c for c in others if c not in (order, size)))))
    grouped = items.groupBy(group).agg(ordered.alias("rows"))
    numbered = grouped.withColumn("starts", starts_of(F.transform("rows", lambda r: r[size].cast("long")), cap, sep, strict))
    ends = F.transform("starts", lambda x, k: F.coalesce(F.try_element_at("starts", k + 2), F.size("rows")))
    cut = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.slice("rows", x["starts"] + 1, x["ends"] - x["starts"]))
    parts = numbered.withColumn("ends", ends).select(group, F.posexplode(cut).alias("batch", "part"))
    flat = parts.select(group, "batch", F.explode("part").alias("x"))
    return flat.select(group, *(F.col(f"x.{c}").alias(c) for c in others), "batch")


def prompt(hits: DataFrame, budget: int, documents: int = DOCUMENTS) -> DataFrame:
    """One row: the first documents with a header each, joined until the budget of characters is spent.

    hits: rank, title, content. The document that crosses the budget is cut there.
    """
    top = hits.orderBy("rank").limit(documents)
    part = F.concat(F.lit("## "), "title", F.lit("\n"), "content", F.lit("\n"))
    rows = top.select("rank", part.alias("part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("before", before).filter(F.col("before") < budget).withColumn("part", F.substring("part", F.lit(1), (budget - F.col("before")).cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return cut.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("prompt"), F.count(F.lit(1)).alias("documents"))
