"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions and labels every byte with a distribution
over the languages. Long texts are read in windows of WINDOW bytes: the forward direction starts
CONTEXT bytes before its window and the backward direction CONTEXT bytes after it, so a byte is judged
by the text on either side, across words and windows. A document pools all bytes of its whole text:
the language with the largest sum of log probabilities is predicted, its score is its mean probability.

Training is backpropagation through time in numpy, in one executor task, on a bounded sample: at most
about DOCS_PER_LANGUAGE documents a language (by hash) and SPANS spans of SPAN bytes of each.
Every language of the rows is learned.

Defined results: `und` and score 0 if the text is null or has no letter, or if nothing could be
learned; every input row gives one row, null (held_out false) and repeated doc_ids included; an empty
table gives an empty result; columns beside doc_id, text and, in training, lang are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HIDDEN, WINDOW, CONTEXT = 12, 160, 16
#: The training sample: documents a language, spans a document, bytes of a span.
DOCS_PER_LANGUAGE, SPANS, SPAN = 500, 12, 48
STEPS, BATCH, RATE = 400, 128, 0.015
#: Windows computed side by side.
ABREAST = 1024
UNKNOWN = "und"
BLANK = 32


def reject_below(languages: int) -> float:
    """A document below this mean probability is rejected by the pipeline's stage: little better than a guess among the languages."""
    return min(0.5, 1.2 / max(1, languages))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ByteGru:
    """Two directions of gated recurrent units over bytes and a softmax at every byte.

    Arrays have features first and windows last. A gate's bias is part of its bytes' columns.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        n = len(languages)
        small = lambda *s: (rng.normal(size=s) / np.sqrt(s[1])).astype(np.float32)
        self.p = {"V": small(n, 2 * hidden), "d": np.zeros(n, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": rng.normal(size=(3 * hidden, 256)).astype(np.float32) * 0.3, f"U{k}": small(3 * hidden, hidden)}

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, languages: list[str], raw: bytes) -> ByteGru:
        with np.load(io.BytesIO(raw)) as kept:
            p = dict(kept)
        net = cls(languages, p["Uf"].shape[1])
        net.p = p
        return net

    def _read(self, x: np.ndarray, k: str) -> np.ndarray:
        """States after each byte of x (length, windows), shape (length, hidden, windows)."""
        n = self.h
        half = np.where(np.arange(3 * n) < 2 * n, 0.5, 1).astype(np.float32)[:, None]  # a sigmoid is a tanh of half
        W, U = self.p[f"W{k}"] * half, self.p[f"U{k}"] * half
        g, u = (np.empty((3 * n, x.shape[1]), np.float32) for _ in range(2))
        s = np.zeros((n, x.shape[1]), np.float32)
        out = np.empty((len(x), n, x.shape[1]), np.float32)
        gates, cand = g[: 2 * n], u[2 * n :]
        for t in range(len(x)):
            np.take(W, x[t], axis=1, out=g, mode="clip")
            np.dot(U, s, out=u)
            gates += u[: 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            cand *= gates[n:]
            cand += g[2 * n :]
            np.tanh(cand, out=cand)
            s -= cand
            s *= gates[:n]
            s += cand
            out[t] = s
        return out

    def _kept(self, x: np.ndarray, k: str) -> tuple[np.ndarray, list]:
        """As _read, with what its gradient needs."""
        W, U, n = self.p[f"W{k}"], self.p[f"U{k}"], self.h
        s, states, kept = np.zeros((n, x.shape[1]), W.dtype), [], []
        for t in range(len(x)):
            g, u = W[:, x[t]], U @ s
            zr = _sigmoid(g[: 2 * n] + u[: 2 * n])
            z, r = zr[:n], zr[n:]
            cand = np.tanh(g[2 * n :] + r * u[2 * n :])
            kept.append((s, z, r, cand, u[2 * n :]))
            s = cand + z * (s - cand)
            states.append(s)
        return np.stack(states), kept

    def _back(self, x: np.ndarray, k: str, kept: list, d_out: np.ndarray, grad: dict) -> None:
        U, n = self.p[f"U{k}"], self.h
        d_s = np.zeros_like(kept[0][0])
        d_g = np.empty((3 * n, *x.shape), U.dtype)
        dU = np.zeros_like(U)
        for t in range(len(x) - 1, -1, -1):
            s, z, r, cand, u_n = kept[t]
            d = d_s + d_out[t]
            d_cand = d * (1 - z) * (1 - cand**2)
            d_z = d * (s - cand) * z * (1 - z)
            d_r = d_cand * u_n * r * (1 - r)
            d_g[:, t] = np.concatenate([d_z, d_r, d_cand])
            d_u = np.concatenate([d_z, d_r, d_cand * r])
            d_s = d * z + U.T @ d_u
            dU += d_u @ s.T
        hot = np.zeros((x.size, 256), U.dtype)
        hot[np.arange(x.size), x.ravel()] = 1
        grad |= {f"W{k}": d_g.reshape(3 * n, -1) @ hot, f"U{k}": dU}

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        V = self.p["V"]
        o = np.matmul(V[:, : self.h], forward)
        o += np.matmul(V[:, self.h :], backward)
        o += self.p["d"][:, None]
        o -= o.max(1, keepdims=True)
        o -= np.log(np.exp(o).sum(1, keepdims=True))
        return o

    def log_probabilities(self, x: np.ndarray, context: int = CONTEXT) -> np.ndarray:
        """(length, languages, windows) for bytes x (context + length + context, windows)."""
        n = len(x) - 2 * context
        forward = self._read(x[: context + n], "f")[context:]
        backward = self._read(x[context:][::-1], "b")[context:][::-1]
        return self._softmax(forward, backward)

    def gradients(self, x: np.ndarray, labels: np.ndarray, context: int = CONTEXT) -> tuple[float, dict]:
        """Mean cross-entropy over the labelled bytes of x (context + length + context, windows) and its gradients."""
        n, h = len(x) - 2 * context, self.h
        xf, xb = x[: context + n], x[context:][::-1]
        (sf, kf), (sb, kb) = self._kept(xf, "f"), self._kept(xb, "b")
        forward, backward = sf[context:], sb[context:][::-1]
        lp = self._softmax(forward, backward)
        at = np.arange(x.shape[1])
        loss = -lp[:, labels, at].mean()
        d_o = np.exp(lp)
        d_o[:, labels, at] -= 1
        d_o /= n * x.shape[1]
        both = np.concatenate([forward, backward], 1)
        grad = {"V": np.einsum("tlb,thb->lh", d_o, both, optimize=True), "d": d_o.sum((0, 2))}
        d_h = np.matmul(self.p["V"].T, d_o)
        none = np.zeros((context, h, x.shape[1]), d_h.dtype)
        self._back(xf, "f", kf, np.concatenate([none, d_h[:, :h]]), grad)
        self._back(xb, "b", kb, np.concatenate([none, d_h[::-1, h:]]), grad)
        return float(loss), grad

    def train(self, spans: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, context: int = CONTEXT, seed: int = 11) -> float:
        """Adam on batches of spans (rows of bytes), the languages balanced; some lose their context, as texts begin and end."""
        rng = np.random.default_rng(seed)
        weights = 1 / np.bincount(labels, minlength=len(self.languages))[labels]
        odds = np.cumsum(weights) / weights.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = np.minimum(np.searchsorted(odds, rng.random(batch)), len(labels) - 1)
            x = spans[pick].T.copy()
            x[:context, rng.random(batch) < 0.1] = BLANK
            x[len(x) - context :, rng.random(batch) < 0.1] = BLANK
            now, grad = self.gradients(x, labels[pick], context)
            loss = now if step == 1 else 0.98 * loss + 0.02 * now
            lr = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v2[name] = 0.995 * v2[name] + 0.005 * g * g
                self.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        return loss


def windows_of(raw: bytes, window: int = WINDOW, context: int = CONTEXT) -> np.ndarray:
    """(windows, context + window + context) bytes of a text, blank beyond its ends."""
    count = -(-len(raw) // window)
    padded = np.full(2 * context + count * window, BLANK, np.uint8)
    padded[context : context + len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, window + 2 * context)[::window]


class Pooler:
    """Labels every byte of texts and pools them by text."""

    def __init__(self, net: ByteGru):
        self.net, self.k = net, len(net.languages)

    def _add(self, windows: np.ndarray, left: np.ndarray, of: np.ndarray, total: np.ndarray) -> None:
        lp = self.net.log_probabilities(windows.T)
        p = np.exp(lp)
        if left.min() < WINDOW:
            inside = np.arange(WINDOW)[:, None, None] < left
            lp *= inside
            p *= inside
        np.add.at(total, of, np.concatenate([lp.sum(0), p.sum(0)]).T)

    def pool(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raws = [t.encode("utf-8", "surrogatepass") if self.k and t is not None and any(map(str.isalpha, t)) else b"" for t in texts]
        total = np.zeros((len(texts), 2 * self.k))
        held: list[np.ndarray] = []
        left: list[np.ndarray] = []
        of: list[np.ndarray] = []
        count = 0
        for i, raw in enumerate(raws):
            if not raw:
                continue
            w = windows_of(raw)
            for a in range(0, len(w), ABREAST):
                part = w[a : a + ABREAST]
                held.append(part)
                left.append(np.minimum(WINDOW, len(raw) - WINDOW * np.arange(a, a + len(part))))
                of.append(np.full(len(part), i))
                count += len(part)
                if count >= ABREAST:
                    self._add(np.concatenate(held), np.concatenate(left), np.concatenate(of), total)
                    held, left, of, count = [], [], [], 0
        if held:
            self._add(np.concatenate(held), np.concatenate(left), np.concatenate(of), total)
        langs, scores = [], []
        for raw, row in zip(raws, total):
            best = int(np.argmax(row[: self.k])) if raw else -1
            langs.append(self.net.languages[best] if raw else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, row[self.k + best] / len(raw)))) if raw else 0.0)
        return langs, scores


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> ByteGru:
    """A network from a bounded sample of the rows with a text and a language; only its weights reach the driver."""
    common.small_batches(labelled.sparkSession)
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"), labelled[id_col].cast("string").alias("id"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return ByteGru([])
    languages = [r["lang"] for r in counts]
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, DOCS_PER_LANGUAGE / r["count"]))))
    chosen = rows.filter((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003) < share[F.col("lang")])
    size = SPAN + 2 * CONTEXT
    place = f"1 + pmod(xxhash64(id, k), greatest(1, length(text) - {size - 1}))"
    chosen = chosen.select("lang", F.explode(F.expr(f"transform(sequence(1, {SPANS}), k -> substring(text, int({place}), {size}))")).alias("span"))
    number = {x: k for k, x in enumerate(languages)}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(b.column("span").to_pylist(), b.column("lang").to_pylist()))
        got = [(s.encode("utf-8", "surrogatepass"), number[lang]) for s, lang in got if s.strip()]
        net = ByteGru(languages)
        if got:
            spans = np.frombuffer(b"".join(s[:size].ljust(size) for s, _ in got), np.uint8).reshape(-1, size)
            net.train(spans, np.array([k for _, k in got]))
        yield pa.RecordBatch.from_arrays([pa.array([net.to_bytes()], pa.binary())], ["weights"])

    return ByteGru.from_bytes(languages, chosen.repartition(1).mapInArrow(fit, "weights binary").first()["weights"])


def trainable(docs: DataFrame) -> DataFrame:
    return docs.filter(common.crc32_mod("doc_id", 3) != 1)


def _judged(net: ByteGru, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    pooler = Pooler(net)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield part, *pooler.pool(part.column(text_col).to_pylist())


def identified(docs: DataFrame, net: ByteGru) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in _judged(net, batches, "text"):
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(common.crc32_mod("doc_id", 3) == 1, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known: not `und`, mean probability at least reject_below()."""
    net = train(trainable(docs))
    floor = reject_below(len(net.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in _judged(net, batches, "text"):
            yield part.filter(pa.array([x != UNKNOWN and y >= floor for x, y in zip(langs, scores)]))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return identified(docs, train(trainable(docs)))
