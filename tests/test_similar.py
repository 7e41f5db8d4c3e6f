"""Pairs of similar questions, and directory counts kept by deltas, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import catalog, similar


def dice(a, b):
    a, b = ("".join((x or "").lower().split()) for x in (a, b))
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2.0 * sum((x & y).values()) / total if total else 0.0


@pytest.mark.parametrize("least", [0.3, 0.7, 1.0])
def test_pairs_equal_brute_force(spark, least):
    r = random.Random(4)
    base = ["what is a red fox", "what is a red Fox?", "who sleeps in winter", "aaaa", "aa", "a", "", None, "the bear sleeps in winter", "[x] $1 \\d .* [x]", "é🙂é🙂"]
    texts = base + ["".join(r.choice("abc ") for _ in range(r.randint(0, 14))) for _ in range(120)] + ["what is a red fox"] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, question string")
    got = similar.similar_pairs(rows.filter("id % 2 = 0"), rows, least).collect()
    want = {(i, j): dice(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 2 == 0 and dice(a, b) >= least - 1e-12}
    assert {(x.asked_id, x.id) for x in got} == set(want) and len(got) == len(want)
    assert all(abs(x.similarity - want[x.asked_id, x.id]) < 1e-9 for x in got)


def test_pairs_across_tiles_equal_brute_force(spark, monkeypatch):
    """Texts of the same few bigrams, in many parts, with rare grams added pair by pair; no list of pairs by gram."""
    for name, value in {"PART": 16, "GRAMS": 400, "ROWS": 8, "DENSE": 5}.items():
        monkeypatch.setattr(similar, name, value)
    r = random.Random(7)
    texts = ["".join(r.choice(["th", "er", "on", "in "]) for _ in range(r.randint(3, 16))) for _ in range(150)] + ["x" * 90, "x" * 70, "x" * 40, "\U0001f642" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, question string")
    pairs = similar.similar_pairs(rows.filter("id % 2 = 0"), rows, 0.75)
    assert "Generate explode(g" not in pairs._jdf.queryExecution().toString()
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 2 == 0 and dice(a, b) >= 0.75 - 1e-12}
    got = [(x.asked_id, x.id) for x in pairs.collect()]
    assert set(got) == want and len(got) == len(want)


def test_counts_kept_by_deltas(spark):
    r = random.Random(2)
    kinds = [schemas.INDEXED, schemas.ERROR, schemas.SAVED]
    frame = lambda d: spark.createDataFrame([(p, s) for p, s in d.items()], "file_path string, state string")
    held = {f"/{r.choice('ab')}/{r.choice('cd')}/{k}.md": r.choice(kinds) for k in range(60)} | {"x/y.md": kinds[0], "z.md": kinds[1]}
    counts = catalog.rollup(frame(held))
    for _ in range(3):
        gone = {p: held.pop(p) for p in r.sample(sorted(held), 12)}
        new = {p: r.choice(kinds) for p in r.sample(sorted(gone), 5)} | {f"/new/{r.randint(0, 9)}/{k}.md": r.choice(kinds) for k in range(4)}
        gone |= {p: held[p] for p in new if p in held}
        held |= new
        counts = counts.unionByName(catalog.rollup_change(frame(gone), frame(new)))
    asked = spark.createDataFrame([(d,) for d in ["/", "/a/", "/a/c/", "/b/", "/new/", "x/", "/none/"]], "directory_path string")
    want = catalog.directory_status(asked, frame(held).withColumn("doc_id", F.lit(1)))
    assert sorted(map(tuple, catalog.kept_status(asked, counts).collect())) == sorted(map(tuple, want.collect()))
    levels = lambda df: sorted(map(tuple, df.distinct().collect()))
    assert levels(catalog.kept_levels(counts)) == levels(catalog.path_levels(frame(held)))
