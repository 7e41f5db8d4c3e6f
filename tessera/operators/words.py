"""A dictionary of words of scripts without blanks, learned from a corpus by expectation maximisation.

Runs of characters are counted, so that each distinct run is worked on once a round. The first
dictionary is every substring of up to `longest` characters that occurs `least` times and holds together: wherever
it is cut in two, it is `cohesion` times as frequent as its parts would meet by chance (two words side by side
do so about as often as a word is long). A round cuts every run in all
ways, weighed by the dictionary's unigram probabilities, and sums the words' expected counts; words that fall below `least` go.
The dictionary is bounded by `vocabulary` words (the most frequent), which is what the driver and each task hold.

Runs longer than PIECE characters are cut into pieces of that many. Null and empty texts hold no run;
a corpus without runs gives an empty dictionary. Expected counts are rounded to six places before they are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import IDEOGRAPHS
from ..functions.segmentation import Segmenter, substring_counts

PIECE, LONGEST, LEAST, COHESION, ROUNDS, VOCABULARY = 256, 4, 4, 4.0, 4, 100_000
#: Characters of runs that a task works on at once.
CHUNK = 4_000_000


def runs(texts: DataFrame, text_col: str = "text", pattern: str = f"[{IDEOGRAPHS}]+") -> DataFrame:
    """(run, n) of the distinct runs."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(pattern), F.lit(0))
    run = texts.select(F.explode(found).alias("run"))
    places = F.sequence(F.lit(0), F.floor((F.length("run") - 1) / PIECE).cast("int"))
    pieces = run.select(F.explode(F.transform(places, lambda k: F.substring("run", k * PIECE + 1, F.lit(PIECE)))).alias("run"))
    return pieces.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], list[int]]]:
    """Runs and how often they occur, about CHUNK characters at a time."""
    texts, weights, size = [], [], 0
    for frame in frames:
        texts += frame["run"].tolist()
        weights += frame["n"].tolist()
        size += int(frame["run"].str.len().sum())
        if size >= CHUNK:
            yield texts, weights
            texts, weights, size = [], [], 0
    if texts:
        yield texts, weights


def substrings(counted: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, n) of all substrings of up to `longest` characters, overlapping ones included; those of about CHUNK characters are added up before they are shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts, weights in _chunks(frames):
            for found, n in substring_counts(texts, weights, longest):
                yield pd.DataFrame({"word": found, "n": n})

    return counted.mapInPandas(run, "word string, n double").groupBy("word").agg(F.sum("n").alias("n"))


def cohesive(counted: DataFrame, least: float = LEAST, cohesion: float = COHESION) -> DataFrame:
    """The single characters of substrings (word, n), and the longer ones that hold together."""
    single = counted.filter(F.length("word") == 1)
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    longer = counted.filter((F.length("word") > 1) & (F.col("n") >= least))
    cuts = longer.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    cuts = cuts.select("word", "n", F.left("word", F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.length("word")).alias("b"))
    for part in ("a", "b"):
        cuts = cuts.join(counted.select(F.col("word").alias(part), F.col("n").alias(f"n_{part}")), part)
    ratio = F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))
    good = cuts.join(F.broadcast(total)).groupBy("word", "n").agg(F.min(ratio).alias("ratio")).filter(F.col("ratio") >= cohesion)  # one row
    return single.unionByName(good.select("word", "n"))


def kept(words: DataFrame, least: float, vocabulary: int) -> dict[str, float]:
    """The dictionary's words and counts: single characters, and longer words that occur `least` times."""
    rows = words.filter((F.length("word") == 1) | (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(vocabulary)
    return {r.word: r.n for r in rows.collect()}


def expected(counted: DataFrame, words: dict[str, float]) -> DataFrame:
    """(word, n): expected counts over all runs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, sums = Segmenter(words), {}
        for texts, weights in _chunks(frames):
            for word, n in cutter.expected_sums(texts, weights).items():
                sums[word] = sums.get(word, 0.0) + n
        yield pd.DataFrame({"word": pd.Series(list(sums), dtype=object), "n": pd.Series(list(sums.values()), dtype=float)}).round(6)

    return counted.mapInPandas(run, "word string, n double").groupBy("word").agg(F.round(F.sum("n"), 6).alias("n"))


def learn(texts: DataFrame, text_col: str = "text", pattern: str = f"[{IDEOGRAPHS}]+", longest: int = LONGEST, least: float = LEAST, cohesion: float = COHESION, rounds: int = ROUNDS, vocabulary: int = VOCABULARY) -> dict[str, float]:
    """The dictionary: words and their expected counts, at most `vocabulary`."""
    counted = runs(texts, text_col, pattern).persist()
    # parts of a word that occurs often enough do so too
    often = substrings(counted, longest).filter((F.length("word") == 1) | (F.col("n") >= least)).persist()
    try:
        words = kept(cohesive(often, least, cohesion), least, vocabulary)
        often.unpersist()
        for _ in range(rounds):
            if words:
                words = kept(expected(counted, words), least, vocabulary)
    finally:
        often.unpersist()
        counted.unpersist()
    return words
