"""Document quality by a linear-chain conditional random field over lines.

Every non-empty line is labelled good or bad. A line's features are counts and shares of its bytes
and words, cut into BINS levels at quantiles of the training lines; the line's potential sums the
weights of its own levels and of its neighbours' (before and after), and transition weights join
consecutive labels. Forward-backward gives each line's probability of being good; a document's is
their mean weighted by line length, brought to a probability by a logistic fit on the training rows.

Training is by gradient on the exact conditional likelihood, in numpy on the driver, from a bounded
sample of labelled rows: at most DOCS documents a class, LINES lines and BYTES bytes in all, chosen by hash; a
document that would exceed these is left out, those behind it are not; of rows that share a doc_id the smallest text is learned from. Each line's label is its document's. Long documents count as chains of CHAIN lines in training; a score
uses the whole document as one chain.

Defined results: a null, empty or blank text has no lines and gets the share of good training rows;
without training rows of both classes every score is the share of good rows, or 0.5; every input row
gives one row, null (held_out false) and repeated doc_ids included; an empty table gives an empty
result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DOCS, LINES, BYTES = 3_000, 120_000, 64 << 20
BINS, CHAIN = 10, 64
STEPS, RATE, RIDGE = 160, 0.08, 1e-4
THRESHOLD = 0.7

#: Byte classes counted in a line.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "shout", "bar", "symbol", "wide")
_LUT = np.zeros((256, len(CLASSES)), np.int8)
for _b in range(256):
    _c = chr(_b)
    _LUT[_b, CLASSES.index(
        "wide" if _b >= 128 else "lower" if _c.islower() else "upper" if _c.isupper() else "digit" if _c.isdigit()
        else "blank" if _c in " \t\r\v\f" else "stop" if _c in ".,;:'\"()-?" else "shout" if _c == "!" else "bar" if _c == "|" else "symbol"
    )] = 1
FEATURES = (*CLASSES, "length", "word_length", "distinct_words", "same_neighbours", "repeats", "distinct_in_document")


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, line lengths in bytes, lines per text); blank lines don't count."""
    lines: list[bytes] = []
    per, words = [], []
    for text in texts:
        own = [x for x in (text or "").split("\n") if x and not x.isspace()]
        per.append(len(own))
        seen = Counter(own)
        split = [x.split() for x in own]
        all_words = sum(map(len, split))
        fresh = len(set().union(*split)) / all_words if all_words else 1.0
        for x, w in zip(own, split):
            lines.append(x.encode("utf-8", "surrogatepass"))
            n = len(w)
            words.append((n, len(set(w)) / n, sum(map(str.__eq__, w, w[1:])) / n, seen[x], fresh))
    if not lines:
        return np.empty((0, len(FEATURES)), np.float32), np.empty(0, np.int64), np.array(per, np.int64)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(length) - length
    raw = np.frombuffer(b"".join(lines), np.uint8)
    shares = np.stack([np.add.reduceat(_LUT[raw, k], starts, dtype=np.int64) for k in range(len(CLASSES))], 1) / length[:, None]
    w = np.array(words, np.float64)
    more = np.stack([np.log1p(length), np.log(length / w[:, 0]), w[:, 1], w[:, 2], np.log(w[:, 3]), w[:, 4]], 1)
    return np.concatenate([shares, more], 1).astype(np.float32), length, np.array(per, np.int64)


def chain_marginals(unary: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) per line, expected transitions 2x2, log likelihood constant) of chains laid end to end.

    unary: log potential of good less that of bad; trans[x, y]: log potential of y after x. The
    longest chains come first in the working order, so each step works on a shrinking prefix.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    e = np.exp(trans - trans.max())
    top = float(trans.max())
    good = np.empty(len(unary))
    if not longest:
        return good, np.zeros((2, 2)), 0.0
    n0 = active[0]
    alpha = np.empty((len(unary), 2))  # by line, so that one very long chain doesn't widen the others
    up = np.stack([np.exp(np.minimum(-unary, 0)), np.exp(np.minimum(unary, 0))], 1)  # scaled by exp(-max(unary, 0))
    logz = float(np.maximum(unary, 0).sum())
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        a = up[at] if t == 0 else (alpha[at - 1] @ e) * up[at]
        z = a.sum(1, keepdims=True)
        alpha[at] = a / z
        logz += float(np.log(z).sum()) + (top * n if t else 0.0)
    expected = np.zeros((2, 2))
    beta = np.ones((n0, 2))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        p = alpha[at] * beta[:n]
        good[at] = p[:, 1] / p.sum(1)
        if t:
            onward = up[at] * beta[:n]
            pair = alpha[at - 1][:, :, None] * e[None] * onward[:, None, :]
            expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            b = onward @ e.T
            beta[:n] = b / b.sum(1, keepdims=True)
    return good, expected, logz


class LineCrf:
    def __init__(self, base: float = 0.5):
        self.base = base
        self.edges: np.ndarray | None = None
        self.calibration = (1.0, 0.0)

    def _levels(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], side="right") + k * BINS for k in range(x.shape[1])], 1)

    def _columns(self, levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weight columns of each line: own levels, the line before, the line after (or the column of an end), and a constant."""
        n, block = len(levels), len(self.edges) * BINS
        end = np.cumsum(counts)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[(end - counts)[counts > 0]] = True
        last[(end - 1)[counts > 0]] = True
        before = np.where(first[:, None], 3 * block, np.roll(levels, 1, 0) + block)
        after = np.where(last[:, None], 3 * block, np.roll(levels, -1, 0) + 2 * block)
        return np.concatenate([levels, before, after, np.full((n, 1), 3 * block + 1)], 1)

    def fit(self, texts: list[str], labels: np.ndarray) -> LineCrf:
        x, length, per = line_features(texts)
        if len(x) == 0 or len(set(labels.tolist())) < 2:
            return self
        self.edges = np.stack([np.quantile(x[:, k], np.arange(1, BINS) / BINS) for k in range(x.shape[1])])
        y = np.repeat(labels, per).astype(np.float64)
        cut = [min(CHAIN, n - a) for n in per for a in range(0, n, CHAIN)]
        counts = np.array(cut, np.int64)
        columns = self._columns(self._levels(x), per)
        size = int(3 * x.shape[1] * BINS + 2)
        self.w, self.trans = np.zeros(size), np.zeros((2, 2))
        start = np.zeros(len(y), bool)
        start[np.cumsum(counts) - counts] = True
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1].astype(int)[~start[1:]], y[1:].astype(int)[~start[1:]]), 1)
        flat = columns.ravel()
        observed = np.bincount(flat, np.repeat(y, columns.shape[1]), size)
        theta = np.concatenate([self.w, self.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            good, expected, _ = chain_marginals(self.w[columns].sum(1), self.trans, counts)
            grad = np.concatenate([observed - np.bincount(flat, np.repeat(good, columns.shape[1]), size), (seen - expected).ravel()]) / len(y) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        self._calibrate(self._pooled(x, length, per), labels.astype(np.float64))
        return self

    def _pooled(self, x: np.ndarray, length: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals per text; NaN without lines."""
        unary = self.w[self._columns(self._levels(x), per)].sum(1)
        good, _, _ = chain_marginals(unary, self.trans, per)
        of = np.repeat(np.arange(len(per)), per)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(of, good * length, len(per)) / np.bincount(of, length, len(per))

    def _calibrate(self, pooled: np.ndarray, y: np.ndarray) -> None:
        ok = np.isfinite(pooled)
        q = _logit(pooled[ok])
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps on the two logistic parameters
            p = 1 / (1 + np.exp(-np.clip(a * q + b, -30, 30)))
            g = np.array([((y[ok] - p) * q).sum() - 1e-2 * a, (y[ok] - p).sum()])
            s = p * (1 - p)
            h = np.array([[(s * q * q).sum() + 1e-2, (s * q).sum()], [(s * q).sum(), s.sum() + 1e-6]])
            da, db = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a + da, b + db
        self.calibration = (max(a, 1e-3), b)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, length, per = line_features(texts)
        if self.edges is None:
            return np.full(len(texts), self.base)
        a, b = self.calibration
        pooled = self._pooled(x, length, per)
        out = 1 / (1 + np.exp(-np.clip(a * _logit(pooled) + b, -30, 30)))
        return np.where(np.isfinite(pooled), out, self.base)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame) -> LineCrf:
    """Fit on a bounded sample of the labelled rows (doc_id, quality) and their texts."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not share:
        return LineCrf()
    base = share.get(1, 0) / sum(share.values())
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    limit = F.when(F.col("quality") == 1, min(1.0, DOCS / share.get(1, DOCS))).otherwise(min(1.0, DOCS / share.get(0, DOCS)))
    # ids of at most about 2 * DOCS rows: within the counted broadcast bound
    chosen = known.filter(rank < limit).limit(3 * DOCS)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.withColumns({"lines": F.size(F.split("text", "\n")), "size": F.octet_length("text"), "h": F.xxhash64("doc_id", F.lit(1))})
    sizes = rows.select("doc_id", "h", "lines", "size").toPandas().sort_values(["h", "doc_id"])
    taken, used, held = [], 0, 0
    for i, n, size in zip(sizes["doc_id"], sizes["lines"], sizes["size"]):
        if used + n <= LINES and held + size <= BYTES:
            taken.append((int(i),))
            used, held = used + n, held + size
    if not taken:
        return LineCrf(base)
    within = docs.sparkSession.createDataFrame(taken, "doc_id long")
    got = rows.join(F.broadcast(within), "doc_id").select("doc_id", "text", "quality").toPandas().sort_values("doc_id")
    return LineCrf(base).fit(got["text"].tolist(), got["quality"].to_numpy())


def scored(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                score = model.score(part.column("text").to_pylist())
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    common.small_batches(docs.sparkSession)
    held = F.coalesce(common.crc32_mod("doc_id", 4) == 2, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    labels = common.read_table(spark, sf_dir, "labels").filter(common.crc32_mod("doc_id", 4) != 2)
    return scored(docs, train(docs, labels))
