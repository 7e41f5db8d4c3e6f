"""Similar questions for many at once: a set-similarity join on bigrams, by tiles of texts of near sizes.

The Dice similarity of two texts is that of their bigram multisets; numbering the repeats of a bigram makes these sets. Two sets of
n and m grams that are alike to a share t have t / 2 * (n + m) in common, so m lies between n * t / (2 - t) and n * (2 - t) / t. Texts are
put into classes that span more than that factor, so alike ones are in the same class or in neighbouring ones. A class is dealt by hash into parts of
bounded rows and grams, and each part of the asked ones meets each part of the others in a tile of its own: a group whose sets are
compared as products of 0/1 matrices, within the sizes that fit. Bigrams of ordinary prose are shared by nearly all texts, so that lists of
texts by gram would name most pairs many times; a tile writes only the pairs that are alike. The comparisons grow with
asked * questions, what is shuffled with that over PART. Equal texts are compared once, whatever the number of rows that hold them.

Null texts and texts without two characters are like nothing. Rows that share an id give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import bounded

#: Texts and grams of a part, about; rows of one product; grams of a tile that are multiplied, others are added pair by pair; tasks of tiles at most.
PART, GRAMS, ROWS, DENSE, TASKS = 8_192, 4_000_000, 1_024, 4_096, 2_000


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the bigrams of texts, repeats numbered: grams are the same number in all of these texts, no text has one twice."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(p) - 1 for p in points])
    _, pair = np.unique(np.concatenate([p[:-1] << 21 | p[1:] for p in points]), return_inverse=True)
    order = np.lexsort((pair, row))
    row, pair = row[order], pair[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])
    repeat = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return row, np.unique(pair.astype(np.int64) * (int(repeat.max()) + 1) + repeat, return_inverse=True)[1]


def alike(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in left, place in right, similarity) of the pairs of texts, all of two characters or more, that are alike."""
    by_a, by_b = (np.argsort([len(t) for t in side], kind="stable") for side in (left, right))
    row, gram = numbered([left[i] for i in by_a] + [right[i] for i in by_b])
    sizes = np.bincount(row)
    a, b = sizes[: len(left)], sizes[len(left) :]
    ours = row < len(left)
    uses = np.bincount(gram[ours], minlength=int(gram.max()) + 1).astype(np.float64) * np.bincount(gram[~ours], minlength=int(gram.max()) + 1)
    dense = np.argsort(-uses, kind="stable")[:DENSE]
    dense = dense[uses[dense] > 0]
    column = np.full(len(uses), -1)
    column[dense] = np.arange(len(dense))

    def matrix(where: np.ndarray, first: int, rows: int) -> np.ndarray:
        out = np.zeros((rows, len(dense)), np.float32)
        at = column[gram[where]]
        out[row[where][at >= 0] - first, at[at >= 0]] = 1
        return out

    others = matrix(~ours, len(left), len(right))
    seldom = (column[gram] < 0) & (uses[gram] > 0)
    held = {g: rows for g, rows in _by_gram(gram[seldom & ~ours], row[seldom & ~ours] - len(left))}
    factor = (2 - least) / least
    found = []
    for first in range(0, len(left), ROWS):
        last = min(first + ROWS, len(left))
        low, high = np.searchsorted(b, a[first] / factor - 1e-6), np.searchsorted(b, a[last - 1] * factor + 1e-6, "right")
        if low == high:
            continue
        where = ours & (row >= first) & (row < last)
        shared = matrix(where, first, last - first) @ others[low:high].T
        for g, rows in _by_gram(gram[where & seldom], row[where & seldom] - first):
            theirs = held[g]
            theirs = theirs[(theirs >= low) & (theirs < high)] - low
            shared[np.ix_(rows, theirs)] += 1
        total = np.add.outer(a[first:last].astype(np.float32), b[low:high].astype(np.float32))
        x, y = np.nonzero(shared >= least / 2 * total - 1)  # about; exactly below
        similarity = 2.0 * shared[x, y].astype(np.float64) / (a[first + x] + b[low + y])
        good = similarity >= least
        found.append((by_a[first + x[good]], by_b[low + y[good]], similarity[good]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _by_gram(gram: np.ndarray, row: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(gram, kind="stable")
    names, starts = np.unique(gram[order], return_index=True)
    return list(zip(names.tolist(), np.split(row[order], starts[1:]))) if len(names) else []


def _compared(least: float) -> Callable[[pa.Table], pa.Table]:
    def tile(rows: pa.Table) -> pa.Table:
        sides = [rows.filter(pa.compute.equal(rows["asked"], side)) for side in (True, False)]
        keys, texts = ([s[c].to_pylist() for s in sides] for c in ("k", "t"))
        x, y, similarity = alike(*texts, least) if all(texts) else ([], [], [])
        return pa.table({"k_a": pa.array([keys[0][i] for i in x], pa.binary()), "k_b": pa.array([keys[1][i] for i in y], pa.binary()), "similarity": pa.array(similarity, pa.float64())})

    return tile


def similar_pairs(asked: DataFrame, questions: DataFrame, least: float = 0.7) -> DataFrame:
    """(asked_id, id, similarity) of asked (id, question) and questions (id, question) that are alike to `least` (above 0) or more."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0")
    bare = lambda df, name: df.select(F.col("id").alias(name), tx.bare(F.lower("question")).alias("t")).withColumn("k", F.unhex(F.md5(F.encode("t", "UTF-8"))))
    a, b = bare(asked, "asked_id"), bare(questions, "id")
    both = a.select("k", "t", F.lit(True).alias("a"), F.lit(False).alias("b")).union(b.select("k", "t", F.lit(False), F.lit(True)))
    texts = both.filter(F.length("t") > 1).groupBy("k").agg(F.first("t").alias("t"), F.max("a").alias("a"), F.max("b").alias("b"))
    n, base = F.length("t") - 1, max(1.25, (2 - least) / least * 1.001)
    texts = texts.withColumn("size", F.floor(F.log(n.cast("double")) / math.log(base)).cast("int"))

    parts = [F.greatest(F.ceil(F.count_if(side) / PART), F.ceil(F.sum(F.when(F.col(side), n).otherwise(0)) / GRAMS)).cast("int").alias(side) for side in ("a", "b")]
    classes = {r["size"]: r for r in texts.groupBy("size").agg(*parts).collect()}  # as many as a logarithm of the longest text
    met = [(x, i, y, j) for x, r in classes.items() for y in (x - 1, x, x + 1) if y in classes for i in range(r["a"]) for j in range(classes[y]["b"])]
    tiles = asked.sparkSession.createDataFrame([(k, *m) for k, m in enumerate(met)], "tile int, size_a int, part_a int, size_b int, part_b int")
    of = asked.sparkSession.createDataFrame([(x, r["a"], r["b"]) for x, r in classes.items()], "size int, parts_a int, parts_b int")

    def dealt(side: str) -> DataFrame:
        part = F.pmod(F.xxhash64("k"), F.greatest(F.col(f"parts_{side}"), F.lit(1))).cast("int")
        rows = texts.filter(side).join(F.broadcast(of), "size").select(F.col("size").alias(f"size_{side}"), part.alias(f"part_{side}"), "k", "t")
        return rows.join(bounded.broadcast(tiles), [f"size_{side}", f"part_{side}"]).select("tile", F.lit(side == "a").alias("asked"), "k", "t")

    rows = dealt("a").unionByName(dealt("b")).repartition(max(1, min(len(met), TASKS)), "tile")
    alike_ = rows.groupBy("tile").applyInArrow(_compared(least), "k_a binary, k_b binary, similarity double")
    out = alike_.join(a.select("asked_id", F.col("k").alias("k_a")), "k_a").join(b.select("id", F.col("k").alias("k_b")), "k_b")
    return out.select("asked_id", "id", "similarity")
