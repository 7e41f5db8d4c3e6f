"""Words of scripts without blanks: the likeliest cut of a run of characters into words of a unigram dictionary.

A run's lattice has an edge for each dictionary word that stands in it, and one for each single character, so that
every run can be cut. best() is Viterbi's cut; expected() the expected count of each word over all cuts,
each weighed by its probability, which is what expectation maximisation sums up. breaks() and expected_sums()
do the same for many runs at once, a place of all of them at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Segmenter:
    """words: counts of the dictionary's words. A character that no word holds counts UNSEEN times."""

    UNSEEN = 0.1
    #: Runs that are worked on at once, and places of them. Fewer runs than FEW are cut one by one.
    TOGETHER, PLACES, FEW = 1_024, 1 << 18, 12
    #: The least probability of a character, and what sums of probabilities may fall to before they are scaled.
    LEAST, SCALED = 1e-20, 1e-200

    def __init__(self, words: dict[str, float]):
        total = math.log(sum(words.values()) + self.UNSEEN)
        self.logs = {w: _exact(math.log(n) - total) for w, n in words.items() if n > 0}
        self.ids = {w: i for i, w in enumerate(self.logs)}
        self.longest = max(map(len, words), default=1)
        self.unseen = _exact(math.log(self.UNSEEN) - total)
        self.lattice: Lattice | None = None

    def edges(self, run: str, start: int) -> Iterator[tuple[int, float]]:
        """(end, log probability) of the words that start at a place."""
        get = self.logs.get
        for end in range(start + 1, min(len(run), start + self.longest) + 1):
            log = get(run[start:end])
            if log is not None:
                yield end, log
            elif end == start + 1:
                yield end, self.unseen

    def best(self, run: str) -> list[str]:
        """The likeliest words in order; of cuts that are equally likely the one of fewer words, then the one whose last words are longer."""
        top: list[tuple[float, int, int] | None] = [(0.0, 0, 0)] + [None] * len(run)  # score, -words, start of the last
        for at in range(len(run)):
            score, words, _ = top[at]
            for end, log in self.edges(run, at):
                found, own = top[end], (score + log, words - 1, at)
                if found is None or own[:2] > found[:2]:
                    top[end] = own
        out, at = [], len(run)
        while at:
            start = top[at][2]
            out.append(run[start:at])
            at = start
        return out[::-1]

    def expected(self, run: str) -> dict[str, float]:
        """Expected counts of words over all cuts (forward and backward sums of logs)."""
        n = len(run)
        edges = [list(self.edges(run, k)) for k in range(n)]
        into, onward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for at in range(n):
            for end, log in edges[at]:
                into[end] = _added(into[end], into[at] + log)
        for at in range(n - 1, -1, -1):
            for end, log in edges[at]:
                onward[at] = _added(onward[at], onward[end] + log)
        out: dict[str, float] = {}
        for at in range(n):
            for end, log in edges[at]:
                word = run[at:end]
                out[word] = out.get(word, 0.0) + math.exp(into[at] + log + onward[end] - into[n])
        return out

    def expected_sums(self, runs: list[str], weights: list[float]) -> dict[str, float]:
        """The sums of expected() of runs, each times its weight, for many runs of similar length at once."""
        sums = np.zeros(0)
        for part in self._parts(runs):
            one = self._sums([runs[i] for i in part], np.array([weights[i] for i in part], float))
            one[: len(sums)] += sums
            sums = one
        names = list(self.ids)
        return {names[i]: float(sums[i]) for i in np.flatnonzero(sums)}

    def breaks(self, runs: list[str]) -> np.ndarray:
        """For each character of the runs, one run after the other, whether a word of best() ends there; for many runs of similar length at once."""
        sizes = np.array([len(r) for r in runs], np.intp)
        starts, out = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), bool)
        for part in self._parts(runs):
            some = [runs[i] for i in part]
            if len(some) >= self.FEW:
                whose, ends = self._ends(some)
                out[starts[part][whose] + ends - 1] = True
            else:
                for i, run in zip(part, some):
                    out[starts[i] + np.cumsum([len(w) for w in self.best(run)], dtype=np.intp) - 1] = True
        return out

    def _parts(self, runs: list[str]) -> Iterator[list[int]]:
        """Places of runs of similar length, as many as are worked on at once."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        first = 0
        while first < len(order):
            many = min(self.TOGETHER, max(1, self.PLACES // max(1, len(runs[order[first]]))))
            yield order[first : first + many]
            first += many

    def _laid(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs' sizes, the lattice's edges (see Lattice.edges) and the logs of its words, the last one that of no word."""
        fresh = sorted(set("".join(runs)) - self.ids.keys())
        if fresh or self.lattice is None:
            for c in fresh:
                self.ids[c] = len(self.ids)
            self.lattice = Lattice(list(self.ids), self.longest)
            self.all_logs = np.array([self.logs.get(w, self.unseen) for w in self.ids] + [-np.inf])
        return *self.lattice.edges(runs), self.all_logs

    def _sums(self, runs: list[str], weights: np.ndarray) -> np.ndarray:
        """The sum of each word of ids, by forward and backward sums of probabilities. Where a forward sum was scaled, the edges across that place are, so that all products stay the same."""
        sizes, edge, logs = self._laid(runs)
        longest, most, each, out = self.longest, int(sizes.max()), np.arange(len(runs)), np.zeros(len(logs))
        least = math.exp(min(self.lattice.least(logs), self.unseen))
        if least < self.LEAST:
            for run, weight in zip(runs, weights.tolist()):
                for word, n in self.expected(run).items():
                    out[self.ids[word]] += n * weight
            return out[:-1]
        every = max(1, int(math.log(self.SCALED) / min(-1.0, math.log(least))))
        p = np.exp(logs)[edge]
        into = np.zeros((most + longest + 1, len(runs)))  # the sum up to a place is `longest` rows on
        into[longest] = 1.0
        for at in range(1, most + 1):
            now = (p[:, at] * into[at : at + longest]).sum(axis=0)
            if at % every == 0:
                scale = 1 / np.where(now > 0, now, 1.0)
                for on in range(longest):
                    p[: longest - on, at + on] *= scale
                now *= scale
            into[at + longest] = now
        onward = np.zeros((most + longest + 1, len(runs)))
        onward[sizes, each] = 1.0
        plane, row, cell = p.strides
        starting = np.lib.stride_tricks.as_strided(p[0, longest:], (longest, most + 1, len(runs)), (plane - row, row, cell))  # [i, at]: the edge of longest - i characters that starts there
        for at in range(most - 1, -1, -1):
            onward[at] += (starting[:, at] * onward[at + longest : at : -1]).sum(axis=0)
        ends = onward[: most + 1] * (weights / into[sizes + longest, each])
        for i in range(longest):
            out += np.bincount(edge[i, : most + 1].ravel(), (into[i : i + most + 1] * p[i, : most + 1] * ends).ravel(), len(out))
        return out[:-1]

    def _ends(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of runs, and places where a word of best() ends in them."""
        sizes, edge, logs = self._laid(runs)
        longest, most, each = self.longest, int(sizes.max()), np.arange(len(runs))
        score, words = np.full((most + longest + 1, len(runs)), -np.inf), np.zeros((most + longest + 1, len(runs)), np.int32)  # up to a place: `longest` rows on
        score[longest] = 0.0
        last = np.zeros((most + 1, len(runs)), np.int32)  # characters of the last word
        for at in range(1, most + 1):
            found = score[at : at + longest] + logs[edge[:, at]]
            top = found.max(axis=0)
            fewest = np.where(found == top, words[at : at + longest], np.iinfo(np.int32).min)
            pick = fewest.argmax(axis=0)  # the first: the longest last word
            score[at + longest], words[at + longest], last[at] = top, fewest[pick, each] - 1, longest - pick
        ending, at, open_ = np.zeros((len(runs), most + 1), bool), sizes.copy(), np.flatnonzero(sizes)
        while len(open_):
            ending[open_, at[open_]] = True
            at[open_] -= last[at[open_], open_]
            open_ = open_[at[open_] > 0]
        return np.nonzero(ending)


class Lattice:
    """Words as a trie in arrays, which finds those that stand in many runs at once."""

    #: Entries of a level's table of children; a larger level is searched.
    TABLE = 1 << 22

    def __init__(self, words: list[str], longest: int):
        self.words, self.longest = words, longest
        points, sizes = _points(words), np.array([len(w) for w in words])
        starts, alphabet = np.cumsum(sizes) - sizes, np.unique(points)
        self.column, self.width = np.zeros(0x110000, np.intp), len(alphabet) + 1  # 0: none
        self.column[alphabet] = np.arange(1, self.width)
        self.levels, node, many = [], np.ones(len(words), np.intp), 2  # nodes of a level are numbered from 1, 0: none
        for size in range(1, longest + 1):
            own = np.flatnonzero(sizes >= size)
            codes, child = np.unique(node[own] * self.width + self.column[points[starts[own] + size - 1]], return_inverse=True)
            node[own] = child + 1
            word, ends = np.full(len(codes) + 1, len(words), np.intp), own[sizes[own] == size]
            word[node[ends]] = ends
            table = None
            if many * self.width <= self.TABLE:
                table = np.zeros(many * self.width, np.intp)
                table[codes] = np.arange(1, len(codes) + 1)
            self.levels.append((codes, table, word))
            many = len(codes) + 1

    def least(self, logs: np.ndarray) -> float:
        """The least log of a single character."""
        return float(logs[self.levels[0][2][1:]].min(initial=0.0, where=self.levels[0][2][1:] < len(self.words)))

    def edges(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs' sizes, and [longest - size, end, run]: the number of the word of that size that ends there, or that of words: none."""
        sizes, longest = np.array([len(r) for r in runs]), self.longest
        most = int(sizes.max())
        laid = np.zeros((len(runs), most + longest), np.intp)
        laid[np.arange(most + longest) < sizes[:, None]] = self.column[_points(runs)]
        laid = np.ascontiguousarray(laid.T)
        edge = np.full((longest, most + longest + 1, len(runs)), len(self.words))
        node = np.ones((most, len(runs)), np.intp)
        for size, (codes, table, word) in enumerate(self.levels, 1):
            code = node * self.width + laid[size - 1 : size - 1 + most]
            if table is not None:
                node = table[code]
            elif len(codes):
                near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                node = np.where(codes[near] == code, near + 1, 0)
            else:
                node = np.zeros_like(code)
            edge[longest - size, size : size + most] = word[node]
        return sizes, edge


def substring_counts(runs: list[str], weights: list[float], longest: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Of each size, the distinct substrings of runs and how often they occur, a run counting as often as its weight says."""
    whole, text, sizes = "".join(runs), _points(runs), np.array([len(r) for r in runs], np.int64)
    if not whole:
        return
    here = np.bincount(text) > 0
    char, chars = (np.cumsum(here) - 1)[text], int(here.sum())
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    own, at = np.repeat(np.array(weights, float), sizes), np.arange(len(text))
    rank, many = np.zeros(len(text), np.int64), 1  # of the substring that is a character shorter
    for size in range(1, longest + 1):
        there = left[at] >= size
        at, rank = at[there], rank[there]
        if not len(at):
            return
        code, codes = rank * chars + char[at + size - 1], many * chars
        if codes <= 4 * len(text) + 65_536:
            here = np.zeros(codes, bool)
            here[code] = True
            rank = (np.cumsum(here) - 1)[code]
            many = int(here.sum())
        else:
            found, rank = np.unique(code, return_inverse=True)
            many = len(found)
        place = np.empty(many, np.int64)
        place[rank] = at
        yield [whole[i : i + size] for i in place.tolist()], np.bincount(rank, own[at], many)


def _points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _exact(log: float) -> float:
    """A log in steps of 2 ** -32, so that sums of logs are exact: the same words in another order are equally likely."""
    return round(log * 2**32) / 2**32


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def cut(text: Column, words: dict[str, float], pattern: str) -> Column:
    """The words of all runs of a pattern, in order; none for a null text."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter, runs = Segmenter(words), re.compile(pattern)
        for texts in batches:
            found = [[r for r in runs.findall(t or "") if r] for t in texts.to_pylist()]
            yield _lists(cutter, found)

    return run(text)


def _lists(cutter: Segmenter, found: list[list[str]]) -> pa.Array:
    """The words of each text's runs: they stand one after the other, so places in the runs' characters are all it takes."""
    flat = [r for own in found for r in own]
    points, ends = _points(flat), np.flatnonzero(cutter.breaks(flat)) + 1
    width = np.cumsum(np.concatenate([[0], 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)]))
    bounds = width[np.concatenate([[0], ends])].astype(np.int32)
    values = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer("".join(flat).encode()))
    size = np.cumsum([0, *(sum(map(len, own)) for own in found)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, size, "right").astype(np.int32)), values)
