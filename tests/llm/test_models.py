import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann_mih as ann
from tessera.llm import language_id as li
from tessera.llm import quality_crf as qc

# -- language ---------------------------------------------------------------------------------


def test_gru_gradients():
    net = li.ByteGru(["a", "b"], hidden=3, seed=1)
    x = np.frombuffer(b"ab  cdefxyz ghijklmn", np.uint8).reshape(2, 10).T
    y = np.array([0, 1])
    _, grad = net.gradients(x, y, context=2)
    for name, at in [("V", (1, 2)), ("d", (0,)), ("Uf", (4, 1)), ("Ub", (8, 0)), ("Uf", (7, 2)), ("Wf", (5, ord("b"))), ("Wb", (1, ord(" "))), ("Wb", (0, ord("n")))]:
        kept, step = net.p[name], 1e-3
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        losses = []
        for sign in (1, -1):
            net.p[name][at] += sign * step
            losses.append(net.gradients(x, y, context=2)[0])
            net.p[name][at] -= sign * step
        assert abs((losses[0] - losses[1]) / (2 * step) - grad[name][at]) < 2e-3, name
        net.p[name] = kept


def plainly(net, text):
    """Language and score of a text by one step a byte and direction, window by window."""
    raw = text.encode()
    sig = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n, total, mass = net.h, np.zeros(len(net.languages)), np.zeros(len(net.languages))

    def states(bytes_, k):
        s, out = np.zeros(n), []
        for b in bytes_:
            g, u = p[f"W{k}"][:, b], p[f"U{k}"] @ s
            z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
            s = z * s + (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :])
            out.append(s)
        return out

    at = lambda i: raw[i] if 0 <= i < len(raw) else 32
    for a in range(0, len(raw), li.WINDOW):
        b = a + li.WINDOW
        f = states([at(i) for i in range(a - li.CONTEXT, b)], "f")[li.CONTEXT :]
        g = states([at(i) for i in range(b + li.CONTEXT - 1, a - 1, -1)], "b")[li.CONTEXT :][::-1]
        for i in range(a, min(b, len(raw))):
            o = p["V"] @ np.concatenate([f[i - a], g[i - a]]) + p["d"]
            o -= np.log(np.exp(o).sum())
            total += o
            mass += np.exp(o)
    best = int(total.argmax())
    return net.languages[best], mass[best] / len(raw)


def test_pooling_equals_a_plain_pass(monkeypatch):
    monkeypatch.setattr(li, "ABREAST", 3)
    net = li.ByteGru(["a", "b", "c"], seed=2)
    texts = ["one two two", "x" * li.WINDOW, "é one " * 150, None, "12 34", "y" * (li.WINDOW + 1), "", "a b " * 400]
    langs, scores = li.Pooler(net).pool(texts)
    for t, lang, score in zip(texts, langs, scores):
        want = ("und", 0.0) if t is None or not any(c.isalpha() for c in t) else plainly(net, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-4
    again = li.ByteGru.from_bytes(net.languages, net.to_bytes())
    assert li.Pooler(again).pool(texts) == (langs, scores)


def test_a_byte_is_judged_by_the_words_around_it():
    net = li.ByteGru(["a", "b"], seed=3)
    row = lambda text: net.log_probabilities(li.windows_of(text).T)
    assert abs(row(b"aaa mid bbb")[4:7] - row(b"xyz mid qrs")[4:7]).max() > 1e-3
    long = b"w" * (li.WINDOW - 2) + b" next words"
    assert abs(row(long)[0, :, 1] - row(b"v" * (li.WINDOW - 2) + b" next words")[0, :, 1]).max() > 1e-4


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = li.op5_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"]))
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(li, "STEPS", 40)
    net = li.train(li.trainable(odd))
    got = li.identified(odd, net).collect()
    assert len(got) == odd.count() and li.identified(none, net).count() == 0
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 8)] == ["und"] * 3
    assert {r.lang_pred for r in li.identified(odd, li.train(none)).collect()} == {"und"}
    kept = li.language_stage(spark, odd, "")
    assert kept.columns == odd.columns and not {3, 4, 8} & {r.doc_id for r in kept.collect()}
    assert sum(r.doc_id is None for r in kept.collect()) == 2


# -- quality ----------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 0, 4])
    unary, trans = rng.normal(size=8) * 3, rng.normal(size=(2, 2))
    good, expected, logz = qc.chain_marginals(unary, trans, counts)
    want, pairs, total, at = np.zeros(8), np.zeros((2, 2)), 0.0, 0
    for n in counts:
        if not n:
            continue
        paths = list(itertools.product((0, 1), repeat=int(n)))
        s = np.array([sum(unary[at + t] * p[t] for t in range(n)) + sum(trans[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        w = np.exp(s - s.max())
        total += np.log(w.sum()) + s.max()
        w /= w.sum()
        for p, x in zip(paths, w):
            want[at : at + n] += x * np.array(p)
            for t in range(n - 1):
                pairs[p[t], p[t + 1]] += x
        at += n
    assert np.allclose(good, want) and np.allclose(expected, pairs) and np.isclose(logz, total)


def test_line_features():
    x, length, per = qc.line_features(["Ab 1!\n\n  \nAb 1!", None, "é"])
    assert per.tolist() == [2, 0, 1] and length.tolist() == [5, 5, 2]
    first = dict(zip(qc.FEATURES, x[0]))
    assert np.isclose(first["lower"], 0.2) and np.isclose(first["shout"], 0.2) and np.isclose(first["repeats"], np.log(2)) and first["distinct_in_document"] == 0.5
    assert x[2][qc.FEATURES.index("wide")] == 1


def test_quality_learns_and_pools():
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    good = ["\n".join(" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(6)) for _ in range(80)]
    bad = ["\n".join("!! ".join(rng.choice(words, 9)).upper() for _ in range(6)) for _ in range(40)]
    model = qc.LineCrf(0.66).fit(good[:60] + bad[:30], np.array([1] * 60 + [0] * 30))
    s = model.score([*good[60:], *bad[30:], "", None, "\n"])
    assert (s[:20] > 0.7).all() and (s[20:30] < 0.3).all() and s[30:].tolist() == [0.66] * 3


def test_quality_of_tables(spark, sf, odd, none):
    got = qc.op9_quality_classifier(spark, sf).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert (labels["quality"] == labels["predicted"]).mean() > 0.85 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = qc.train(odd, empty)
    assert qc.scored(odd, model).count() == odd.count() and qc.scored(none, model).count() == 0
    assert {r.score for r in qc.scored(odd, model).collect()} == {0.5}
    one = qc.train(odd, spark.createDataFrame([(1, 1), (None, 0), (2, None), (99, 1)], "doc_id long, quality int"))
    assert {r.score for r in qc.scored(odd, one).collect()} == {1.0}


def test_quality_of_held_out_documents(spark):
    """Ranks on documents that were not learned from, at a size where there are enough of them."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = qc.op9_quality_classifier(spark, sf).filter("held_out").toPandas()
    known = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    good, bad = (known[known["quality"] == q]["score"].to_numpy() for q in (1, 0))
    auc = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) if len(good) and len(bad) else 0
    assert len(known) > 50 and auc > 0.95, (len(known), auc)


def test_training_rows_are_bounded(spark, monkeypatch):
    rows = [(k, ("Fine words here.\n" if k % 2 else "!! BAD | 77 !!\n") * 3) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(qc.LineCrf, "fit", lambda self, texts, y: fitted.append((sorted(texts), sorted(y))) or self)
    frame = lambda more: spark.createDataFrame(rows + more, "doc_id long, text string")
    qc.train(frame([]), labels)
    # repeated rows, and rows of other text under a known id, are one document
    qc.train(frame(rows[:20] * 3 + [(1, "zzz " * 1000)]), labels)
    assert fitted[0] == fitted[1] and len(fitted[0][0]) == 40
    # one line of very many bytes costs no other document
    monkeypatch.setattr(qc, "BYTES", 10_000)
    qc.train(frame([(50 + k, "x" * 9_000) for k in range(5)]), labels)
    assert sum(map(len, fitted[2][0])) <= 10_000 and len(fitted[2][0]) >= 20


def test_a_document_of_too_many_lines_costs_no_other(spark, monkeypatch):
    monkeypatch.setattr(qc, "LINES", 200)
    rows = [(k, ("Fine words here.\n" if k % 2 else "!! BAD | 77 !!\n") * 3) for k in range(40)] + [(100 + k, "long\n" * 500) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = qc.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"))
    assert model.edges is not None
    assert model.score(["Fine words here.\n" * 3])[0] > 0.7 > 0.3 > model.score(["!! BAD | 77 !!\n" * 3])[0]


# -- nearest neighbours -----------------------------------------------------------------------


def frame(spark, x, extra=()):
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def exact(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


def test_radius_search_finds_every_code():
    """Each once over the substrings."""
    rng = np.random.default_rng(0)
    for d in (20, 40, 64):
        x = rng.normal(size=(2000, d))
        coder = ann.Coder(x[:500])
        codes = coder.codes(x)
        orders = [np.argsort(codes[:, p], kind="stable") for p in range(coder.parts)]
        blocks = [ann.Block(p, o, x[o], codes[o]) for p, o in enumerate(orders)]
        for q in range(0, 2000, 97):
            for r in (0, 3, 7, 19, d):
                want = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(1) <= r)
                got = np.concatenate([block.ids[block.within(codes[q], r)[0]] for block in blocks])
                assert sorted(got.tolist()) == want.tolist()


def test_masks_reach_every_cell_within_the_distance():
    assert ann.masks(0, 3) == [0] and ann.masks(3, 1) == [0, 1, 2, 4] and len(ann.masks(4, 4)) == 16
    assert [ann.prefix_bits(n) for n in (0, 1, ann.BLOCK, ann.BLOCK + 1, 8 * ann.BLOCK, 1 << 60)] == [0, 0, 0, 1, 3, ann.WIDTH]


def clusters(n, d, spread=0.12, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 30, d))[rng.integers(0, n // 30, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["without structure", "in clusters"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "BLOCK", 300)
    x = clusters(3000, 64) if kind == "in clusters" else np.random.default_rng(2).normal(size=(3000, 32))
    got = ann.search(frame(spark, x), "vec_id % 100 = 0").toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        near, d = exact(x, q)
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.array_equal(d[g["vec_id"]], g["score"]) and g["score"].is_monotonic_increasing
        hit += len(set(near) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 30 and hit / 300 >= 0.9
    parts = -(-min(64, x.shape[1]) // ann.WIDTH)
    share = got.groupby("query_id")["probed"].first().mean() / (parts * len(x))
    assert 0 < share < (0.1 if kind == "in clusters" else 0.9)


def test_a_common_vector_and_ties(spark, monkeypatch):
    """A third of the rows is one vector: blocks stay bounded, and of equals the smallest ids come first."""
    monkeypatch.setattr(ann, "BLOCK", 50)
    x = np.random.default_rng(6).normal(size=(600, 16))
    x[::3] = x[0]
    got = ann.search(frame(spark, x), "vec_id % 100 = 0").toPandas()
    for q, g in got.groupby("query_id"):
        near, d = exact(x, q)
        if q % 3 == 0:
            assert g.sort_values("rank")["vec_id"].tolist() == near.tolist()
    assert got["query_id"].nunique() == 6


def test_an_id_of_several_vectors_asks_once(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=16).tolist()) for k in range(60)]
    other = [(0, r.normal(size=16).tolist()), (0, rows[0][1])]
    runs = []
    for order in (1, -1):
        got = ann.search(spark.createDataFrame((rows + other)[::order], "vec_id long, embedding array<double>").repartition(3), "vec_id = 0", 5).collect()
        runs.append(sorted(map(tuple, (x[:4] for x in got))))
    asked = np.array(min([rows[0][1], other[0][1]]))
    far = {i: float(np.sqrt(((np.array(v) - asked) ** 2).sum())) for i, v in rows}
    assert runs[0] == runs[1] and len(runs[0]) == 5 and all(score == pytest.approx(far[i]) for _, _, i, score in runs[0])


def test_ann_of_odd_rows(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    odd = [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, [1.0, 1.0]), (105, []), (106, [1.0]), (0, [1.0, 0.0])]
    rows = frame(spark, x, odd).withColumns({"v": F.lit(1), "rank": F.lit(2)})
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(rows, "vec_id % 100 = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(rows.limit(0), "vec_id % 100 = 0").count() == 0
    assert ann.search(frame(spark, x[:1]), "vec_id % 100 = 0").count() == 0
    assert ann.search(frame(spark, x), "vec_id = 77").count() == 0


@pytest.mark.parametrize("n", [5, 60])
def test_few_vectors_give_all(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 70))
    got = ann.search(frame(spark, x), "vec_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == exact(x, 0, min(10, n - 1))[0].tolist()
