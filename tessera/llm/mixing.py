"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed to cells (source, language, topic); their weights are raked in turn to the
source, language and topic marginals until every marginal is within TOLERANCE of its target or the error
hardly falls any more (then a warning tells the error left). Documents then are sampled with probability min(1, scale * weight) by a hash of
their id; the scale makes the expected tokens KEEP of all tokens. A target is a table of shares over a
margin's values, by default each value's token share raised to POWER (and made to sum to one).

Cells are few beside documents: their number is bounded by the margins' values. Cells and targets are
joined by a broadcast only after counting them, else by sort-merge; sums over all cells are aggregates,
of which only the number reaches the driver.

Defined results: null source or language is the value `(none)`; a null text counts as empty (no
tokens, topic `general`) and, like all documents without tokens, carries its cell's probability, or 0
where the cell has no tokens; a null doc_id is hashed as null. Values without a target take part with
a target share of 0, so their documents are never sampled; rows that share a doc_id fare alike if
their cells do. An empty table gives an empty result. Other columns are kept untouched by the stage.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MARGINS = ("source", "lang", "topic")
TOLERANCE, POWER, KEEP = 1e-9, 0.7, 0.6
#: Rounds between two looks at the error, and the least share of it that they must take off.
LOOK, FALL = 4, 0.1
NONE = "(none)"
#: A marginal that is further off after the last round is told by a warning.
UNCONVERGED = 1e-4
#: Cells up to this number may be broadcast after counting them.
BROADCAST_CELLS = 100_000
#: A document's topic is the first whose pattern its text holds.
TOPICS = {"legal": "License", "tabular": " | ", "contact": "@"}


def topic(text: Column) -> Column:
    named = reduce(lambda c, t: c.when(F.contains(text, F.lit(t[1])), t[0]), TOPICS.items(), F)
    return named.otherwise("general")


def with_margins(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every row; tokens are white-space-delimited words."""
    text = common.text_of(docs, text_col)
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        F.coalesce(docs["source"].cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(docs["lang"].cast("string"), F.lit(NONE)).alias("lang"),
        topic(text).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )


def default_target(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """(margin, share): token shares raised to a power."""
    shares = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    return shares.select(margin, F.coalesce(F.try_divide("p", F.lit(_total(shares, "p"))), F.lit(0.0)).alias("share"))


def _total(rows: DataFrame, column: str) -> float:
    return float(rows.agg(F.sum(F.col(column).cast("double"))).first()[0] or 0.0)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (margins, tokens) with mass, the raked share of all tokens, marginals at their targets.

    A round is one windowed sum a margin. After every LOOK rounds cells are written to the shared folder, which
    bounds the plan, and the worst marginal error is looked at: raking ends when it is within the tolerance, or has
    fallen by less than FALL of it (the targets contradict each other or are met in the limit only; a warning tells the error), or after `rounds`.
    """
    names = list(targets)
    cells = cells.filter("tokens > 0")
    cells = cells.withColumn("mass", F.col("tokens") / F.lit(_total(cells, "tokens")))
    for m in names:
        cells = common.join_counted(cells, targets[m].withColumnRenamed("share", f"t_{m}"), m, "left", BROADCAST_CELLS).fillna(0.0, [f"t_{m}"])
    cells = common.materialize(cells, "cells-0")
    k, before = 0, float("inf")
    while rounds is None or k < rounds:
        for m in names:
            total = F.sum("mass").over(Window.partitionBy(m))
            cells = cells.withColumn("mass", F.when(total > 0, F.col("mass") * F.col(f"t_{m}") / total).otherwise(0.0))
        k += 1
        if k % LOOK and k != rounds:
            continue
        cells = common.materialize(cells, f"cells-{k}")
        worst = [cells.groupBy(m).agg(F.abs(F.sum("mass") - F.first(f"t_{m}")).alias("e")) for m in names]
        errors = reduce(DataFrame.union, [w.select(F.max("e").alias("e")) for w in worst])
        error = errors.agg(F.max("e")).first()[0] or 0.0
        if error <= tolerance:
            break
        if error > (1 - FALL) * before or k == rounds:
            if error > UNCONVERGED:
                warnings.warn(f"raking stopped after {k} rounds with a marginal {error:.2g} off its target", stacklevel=2)
            break
        before = error
    return cells


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with weight (raked share over actual share) and probability min(1, scale * weight).

    The scale leaves the expected tokens at the budget once the cells above it are certain. Fixing it
    makes more cells certain, which raises it, until no cell is added: two sums over the cells a step.
    """
    everything = _total(cells, "tokens")
    scaled = cells.withColumn("weight", F.col("mass") * everything / F.col("tokens"))
    scale, certain = 0.0, -1.0
    while True:
        sure = F.col("weight") * F.lit(scale) > 1
        got = scaled.agg(F.sum(F.when(sure, F.col("tokens")).otherwise(0)), F.sum(F.when(sure, 0.0).otherwise(F.col("mass")))).first()
        sum_certain, rest = float(got[0] or 0), float(got[1] or 0)
        if sum_certain <= certain or rest <= 0:
            break
        certain = sum_certain
        scale = (keep * everything - certain) / (rest * everything)
    if rest <= 0:
        scale = 1e300
    scaled = scaled.withColumn("scale", F.lit(scale))
    p = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("scale") * F.col("weight"))).otherwise(0.0)
    return scaled.select(*MARGINS, "tokens", "mass", "weight", p.alias("probability"))


def draw(id_col: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the id only."""
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(salted.cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def fitted(rows: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    cells = common.materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "cells")
    targets = targets or {m: default_target(cells, m) for m in MARGINS}
    return common.materialize(probabilities(rake(cells, targets), keep), "cell-probabilities")


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    joined = common.join_counted(rows, cells.select(*MARGINS, "weight", "probability"), list(MARGINS), "left", BROADCAST_CELLS)
    return joined.fillna(0.0, ["weight", "probability"])


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, margins, tokens, weight, probability, sampled."""
    rows = common.materialize(with_margins(docs), "margins")
    sampled = draw(F.col("doc_id"), seed) < F.col("probability")
    return with_probability(rows, fitted(rows, targets, keep)).select("doc_id", *MARGINS, "tokens", "weight", "probability", sampled.alias("sampled"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with their own columns; texts aren't shuffled while cells are few."""
    cells = fitted(with_margins(docs))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(c.alias(f"__{m}") for m, c in _margin_columns(docs).items()))
    cells = cells.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("probability").alias("__p"))
    joined = common.join_counted(own, cells, [f"__{m}" for m in MARGINS], "inner", BROADCAST_CELLS)
    return joined.filter(draw(F.col("doc.doc_id")) < F.col("__p")).select("doc.*")


def _margin_columns(docs: DataFrame) -> dict[str, Column]:
    return {
        "source": F.coalesce(docs["source"].cast("string"), F.lit(NONE)),
        "lang": F.coalesce(docs["lang"].cast("string"), F.lit(NONE)),
        "topic": topic(common.text_of(docs)),
    }


def op3_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mix(common.read_table(spark, sf_dir, "documents")))


def rounded(mixed: DataFrame) -> DataFrame:
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


ORACLE_ROUNDS = 24


def _oracle() -> str:
    """The same raking as unrolled SQL: ORACLE_ROUNDS rounds of three windowed sums, more than the tables need."""
    case = " ".join(f"WHEN contains(t, '{p}') THEN '{name}'" for name, p in TOPICS.items())
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t FROM documents),
r AS MATERIALIZED (SELECT doc_id, source, lang, CASE {case} ELSE 'general' END AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL)"""
    ]
    for m in MARGINS:
        steps.append(f"p_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {POWER}::DOUBLE) AS p FROM c GROUP BY 1), t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS t_{m} FROM p_{m})")
    steps.append("k AS MATERIALIZED (SELECT c.*, tokens / (sum(tokens) OVER ())::DOUBLE AS mass, t_source, t_lang, t_topic FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic) WHERE tokens > 0)")
    last = "k"
    for n in range(ORACLE_ROUNDS):
        for m in MARGINS:
            name = f"k{n}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (mass * t_{m} / sum(mass) OVER (PARTITION BY {m}) AS mass) FROM {last})")
            last = name
    steps.append(f"""w AS MATERIALIZED (SELECT source, lang, topic, tokens, mass, (sum(tokens) OVER ())::DOUBLE AS a, mass * (sum(tokens) OVER ())::DOUBLE / tokens AS weight FROM {last}),
s AS (SELECT *, ({KEEP}::DOUBLE * a - coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
 / (sum(mass) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * a) AS sc FROM w),
f AS MATERIALIZED (SELECT source, lang, topic, weight, least(1.0::DOUBLE, weight * max(CASE WHEN sc * weight <= 1 THEN sc END) OVER ()) AS probability FROM s)""")
    draw_sql = "('0x' || substr(md5('0:' || doc_id), 1, 12))::BIGINT::DOUBLE / 281474976710656"
    return f"""WITH {", ".join(steps)}
SELECT doc_id, r.source, r.lang, r.topic, tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(probability, 0), 6) AS probability,
       {draw_sql} < coalesce(probability, 0) AS sampled
FROM r LEFT JOIN f ON r.source = f.source AND r.lang = f.lang AND r.topic = f.topic"""


OP3_SQL = _oracle()
