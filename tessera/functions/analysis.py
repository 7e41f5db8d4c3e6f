"""Text analysis beyond Latin runs: stems of English words, and words of scripts without blanks.

Those words are cut by a dictionary learned from the corpus (operators/words.py); without one, all pairs of
neighbouring characters are terms. One Python function serves queries and, in Arrow batches with a cache of words and runs,
columns of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .segmentation import Segmenter

#: Han, kana and Hangul.
IDEOGRAPHS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af"
#: A run of Latin letters and digits, or of characters of a script without blanks.
RUN = re.compile(f"[a-z0-9à-ÿœ]+|[{IDEOGRAPHS}]+")

# Suffixes of Porter's published algorithm, by step, with what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, suffixes: dict[str, str]) -> str:
    """The longest suffix replaced if what is before it has a measure above 0."""
    for n in range(min(7, len(word)), 1, -1):
        if word[-n:] in suffixes:
            return word[:-n] + suffixes[word[-n:]] if _measure(word[:-n]) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of other letters than a-z, and of two or fewer, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            bare = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(bare):
                if bare.endswith(("at", "bl", "iz")):
                    word = bare + "e"
                elif _doubled(bare) and bare[-1] not in "lsz":
                    word = bare[:-1]
                else:
                    word = bare + "e" if _measure(bare) == 1 and _short(bare) else bare
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    bare = word[: len(word) - len(suffix)]
    if suffix and _measure(bare) > 1 and (suffix != "ion" or bare.endswith(("s", "t"))):
        word = bare
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def pairs(run: str) -> list[str]:
    """All pairs of neighbouring characters."""
    return [run] if len(run) == 1 else [run[k : k + 2] for k in range(len(run) - 1)]


def analyze(text: str | None, cut: Callable[[str], list[str]] = pairs) -> list[str]:
    """Terms of a text in order; cut gives those of a run without blanks."""
    out: list[str] = []
    for run in RUN.findall((text or "").lower()):
        if run[0] < "\u3040":
            out.append(stem(run))
        else:
            out += cut(run)
    return out


def cutter(words: dict[str, float] | None) -> Callable[[str], list[str]]:
    """How runs without blanks are cut: by the dictionary, with a cache, or into pairs."""
    return lru_cache(maxsize=100_000)(Segmenter(words).best) if words else pairs


def tokens(text: Column, words: dict[str, float] | None = None) -> Column:
    """analyze() over a column."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = cutter(words)
        for texts in batches:
            yield texts.map(lambda t: analyze(t, cut))

    return run(text)
