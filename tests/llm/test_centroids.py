import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from fractions import Fraction
from pyspark.sql import functions as F

from tessera.llm import centroids as ce


def brute(rows, k=8, rounds=10, size=64):
    """Lloyd's rounds in Python integers: (vec_id, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in first[:k]]
    if not cents:
        return []
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: min((gap(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    last = [(i, *nearest(v)) for i, v in kept]
    fits = lambda x: x if x <= ce.LONG else None
    own = [sum(d for _, d, j in last if j == c) for c in range(len(cents))]
    return [(i, j, fits(d), fits(own[j]), fits(sum(own)), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last]


def run(spark, rows, path, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("cluster", "v", "data", "ids", "distance")})
    frame.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    got = ce.op13_centroids(spark, str(path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def vectors(n, seed, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, np.float32(scale * r.normal(size=64)).tolist()) for i in range(n)]


def test_equals_integer_rounds(spark, tmp_path):
    rows = vectors(300, 1)
    assert run(spark, rows, tmp_path) == sorted(brute(rows), key=str)


def test_beyond_the_bound_integers_decide(spark, tmp_path):
    r = random.Random(4)
    rows = vectors(60, 2) + [(100 + i, [float(np.float32(r.choice([-1, 1]) * 10 ** r.uniform(0, 38))) for _ in range(64)]) for i in range(20)]
    rows += [(200 + i, [x * 3e5 for x in v]) for i, v in vectors(40, 3)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, tmp_path / "a") == sorted(brute(rows), key=str)
    wide = [(i, [x * (1 + 2**-40) for x in v]) for i, v in rows] + [(900, [1.7e308] * 64), (901, [-5e-324] * 64)]
    assert run(spark, wide, tmp_path / "b", "double") == sorted(brute(wide), key=str)


def test_every_pair_is_decided_exactly():
    r = np.random.default_rng(7)
    for scale in (1.0, 1e3, 1e4, 1e5, 1e6, 1e10, 1e30):
        raw = r.normal(size=(40, 8)) * scale
        cents = [ce.integers(raw[i]) for i in range(6)] + [ce.integers(r.normal(size=8))]
        data = ce.unpacked(raw.tobytes(), 8, 1024, True)
        clusters, far = ce.assigned(data, cents)
        want = [min((ce.squared(ce.integers(x), c), j) for j, c in enumerate(cents)) for x in raw]
        assert [(int(d), int(j)) for d, j in zip(far, clusters)] == want
        zero = [[0] * 10 for _ in cents]
        sums = ce.gathered(zero, data, cents)
        for j in range(len(cents)):
            own = [ce.integers(x) for x, (_, w) in zip(raw, want) if w == j]
            assert sums[j] == [len(own), sum(d for d, w in want if w == j), *([sum(t) for t in zip(*own)] if own else [0] * 8)]


def test_odd_rows_and_ties(spark, tmp_path):
    one, two = [0.5] * 64, [-0.25] * 64
    rows = [(1, one), (1, two), (2, one), (3, None), (4, []), (5, one[:63]), (6, [*one, 1.0]), (7, [None, *one[:63]]), (8, [float("nan"), *one[:63]]), (9, [float("inf"), *one[:63]]), (None, one), (None, two), (10, [0.0] * 64)]
    rows += [(100 + i, one) for i in range(40)]
    assert run(spark, rows, tmp_path / "a") == sorted(brute(rows), key=str)
    few = [(1, one), (2, two), (None, one)]
    assert run(spark, few, tmp_path / "b") == sorted(brute(few), key=str)
    for name, rows in {"c": [], "d": [(None, one)], "e": [(3, None)]}.items():
        assert run(spark, rows, tmp_path / name) == []


def test_blocks_and_batches_do_not_matter(spark, tmp_path, monkeypatch):
    rows = vectors(200, 5)
    a = run(spark, rows, tmp_path / "a")
    monkeypatch.setattr(ce, "BLOCK", 7)
    assert run(spark, rows, tmp_path / "b") == a


@pytest.mark.parametrize("seed", [1, 2])
def test_sql(spark, tmp_path, seed):
    rows = vectors(120, seed) + [(7, None), (8, [1.0])]
    got = run(spark, rows, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ce.OP13_SQL)
    at = [want.columns.index(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
