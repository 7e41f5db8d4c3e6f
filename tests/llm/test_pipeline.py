"""The pipeline: each stage against a plain restatement of it, and the whole on the smallest tables."""

import hashlib

import corpus_pipeline
from tessera.llm import language_id
from tests.llm.test_dedup import brute, lower, pairs_at


def test_stages_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]

    known = stages["language"](spark, docs, sf).cache()
    net = language_id.train(language_id.trainable(docs))
    judged = {r.doc_id: r for r in language_id.identified(docs, net).collect()}
    kept = {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= language_id.reject_below(len(net.languages))}
    assert {r.doc_id for r in known.collect()} == kept and known.columns == columns

    single = stages["exact_dedup"](spark, known, sf).cache()
    last = {}
    for r in known.collect():
        sha = hashlib.sha256(lower(r.text).encode()).digest()
        last[sha] = max(last.get(sha, -1), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values()) and single.columns == columns

    apart = stages["near_dedup"](spark, single, sf).cache()
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in single.collect()], 80).items() if i == c}
    assert {r.doc_id for r in apart.collect()} == want and apart.columns == columns

    mixed = stages["mixing"](spark, apart, sf).cache()
    assert {r.doc_id for r in mixed.collect()} < want and mixed.columns == columns
    assert mixed.exceptAll(apart).count() == 0

    packed = stages["packing"](spark, mixed, sf).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in mixed.collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_on_odd_rows(spark, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            if name != "packing":
                assert docs.columns == odd.columns
        docs.collect()


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))


def test_near_copies_from_80_on_are_removed(spark):
    texts = [t for percent in (79, 80, 82, 84, 86) for pair in pairs_at(percent, 6, percent) for t in pair]
    rows = list(enumerate(texts))
    want = {i for i, (_, c) in brute(rows, 80).items() if i == c}
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == want and want < {i for i, (_, c) in brute(rows).items() if i == c}
