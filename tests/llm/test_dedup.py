import hashlib
import itertools
import re

import numpy as np
import pytest

from tessera.llm import exact_dedup as ex
from tessera.llm import minhash_dedup as mh


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_exact_on_odd_rows(spark, odd, none):
    got = ex.exact_dedup(odd).collect()
    assert len(got) == odd.count() and ex.exact_dedup(none).count() == 0
    by = {}
    for r in odd.collect():
        by.setdefault(hashlib.sha256(lower(r.text).encode()).hexdigest(), []).append(r.doc_id)
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for sha, ids in by.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {5} and {r.keep_id for r in got if r.doc_id in (6, 7)} == {6, 7}


def test_exact_stage(spark, odd, none):
    kept = ex.exact_dedup_stage(spark, odd, "")
    assert kept.columns == odd.columns and ex.exact_dedup_stage(spark, none, "").count() == 0
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 4, 5, 6, 7, 8, 9, 10]


def test_same_id_with_other_text_stays(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "y")], "doc_id long, text string")
    assert sorted(map(tuple, ex.exact_dedup_stage(spark, rows, "").collect())) == [(1, "x"), (2, "y")]


def test_index_outlives_a_batch(spark, tmp_path):
    at = str(tmp_path / "digest-index-1")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = lambda: ex.DigestIndex(spark, at, 4)
    first = ex.exact_dedup(make([(1, "a"), (2, "A"), (3, "b")]), index())
    assert {r.doc_id: r.kept for r in first.collect()} == {1: False, 2: True, 3: True}
    second = ex.exact_dedup(make([(4, "a"), (5, "c"), (6, "B")]), index())
    assert {r.doc_id: (r.keep_id, r.kept) for r in second.collect()} == {4: (2, False), 5: (5, True), 6: (3, False)}
    assert index().read().count() == 3
    index().compact()
    index().compact()
    assert index().generation == 2 and index().read().count() == 3
    plan = index().fresh(index().read())._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    third = ex.exact_dedup(make([(7, "C"), (8, "d")]), index())
    assert {r.doc_id: (r.keep_id, r.kept) for r in third.collect()} == {7: (5, False), 8: (8, True)}
    index().drop()


def test_indexes_of_one_base_name_are_apart(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (ex.DigestIndex(spark, str(tmp_path / x / "index"), 4) for x in ("one", "two"))
    ex.exact_dedup(make([(1, "a"), (2, "b")]), one)
    assert {r.doc_id: r.kept for r in ex.exact_dedup(make([(7, "a")]), two).collect()} == {7: True}
    assert one.read().count() == 2 and two.read().count() == 1 and one.table != two.table
    same = ex.DigestIndex(spark, f"file://{tmp_path}/one/index/", 4)
    assert same.table == one.table and same.read().count() == 2
    one.compact()
    assert same.read().count() == 2 and same.generation == 1  # a session that held the generation before
    for index in (one, two):
        index.drop()


def test_a_table_that_lies_elsewhere_is_refused(spark, tmp_path, monkeypatch):
    one = ex.DigestIndex(spark, str(tmp_path / "one"), 4)
    monkeypatch.setattr(ex.DigestIndex, "table", one.table)
    with pytest.raises(ValueError):
        ex.DigestIndex(spark, str(tmp_path / "two"), 4)
    monkeypatch.undo()
    one.drop()


def test_a_batch_run_again_loses_nothing(spark, tmp_path):
    """The result of a batch is lost after the append: the second run decides as the first did."""
    at = str(tmp_path / "digest-index-2")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "A"), (None, "c"), (None, "d"), (4, "d")], "doc_id long, text string")
    runs = [sorted(map(str, ex.exact_dedup(rows, ex.DigestIndex(spark, at, 4)).select("doc_id", "keep_id", "kept").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and sum("kept=True" in r for r in runs[0]) == 4
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
    ex.exact_dedup(rows)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")] == tables


def test_stage_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "x", 0, 1), (1, "y", 2, 3)], "doc_id long, text string, exact_sha int, Exact_Of int")
    assert sorted(map(tuple, ex.exact_dedup_stage(spark, rows, "").collect())) == [(1, "x", 0, 1), (1, "y", 2, 3)]


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed=1):
    """Copies with few and many changed words: linked, nearly linked and chained texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for size, copies in ((60, 12), (150, 40), (20, 6), (300, 8)):
        base = list(rng.choice(words, size))
        for _ in range(copies):
            own = list(base)
            for at in rng.choice(size, rng.integers(0, max(2, size // 25)), replace=False):
                own[at] = "X%d" % rng.integers(1000)
            rows.append((n, " ".join(own)))
            n += 1
    chain = list(rng.choice(words, 120))
    for k in range(8):
        chain[k * 11] = f"Y{k}"
        rows.append((n + k, " ".join(chain)))
    return [(int(i), str(t)) for i, t in rows]


@pytest.mark.parametrize("block, offsets, size", [(1024, 8, 1 << 24), (7, 1, 1 << 24), (1024, 2, 3000)])
def test_near_equals_brute_force(spark, monkeypatch, block, offsets, size):
    for name, x in (("BLOCK", block), ("NEIGHBOURS", offsets), ("BLOCK_BYTES", size), ("ROUNDS", int(block == 1024))):
        monkeypatch.setattr(mh, name, x)
    rows = near_rows()
    got = mh.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) > 4


def test_near_on_odd_rows(spark, odd, none):
    got = mh.near_dedup(odd).collect()
    assert mh.near_dedup(none).count() == 0 and len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[3].n_shingles, by[3].component_id, by[3].kept) == (0, 3, True)
    assert [by[i].component_id for i in (1, 2, 5)] == [1, 1, 1] and by[6].component_id == 6 and by[9].n_shingles == 7
    # of the null ids one is a copy of document 1, one stands alone
    assert sorted(map(str, [(r.component_id, r.kept, r.stays) for r in got if r.doc_id is None])) == ["(1, False, False)", "(None, True, True)"]
    kept = mh.near_dedup_stage(spark, odd, "")
    assert kept.columns == odd.columns and [r.text for r in kept.collect() if r.doc_id is None] == ["a null id of its own"]
    assert mh.near_dedup_stage(spark, none, "").count() == 0
    with pytest.raises(ValueError):
        mh.near_dedup(odd, percent=60)


def test_rows_that_share_an_id_are_judged_apart(spark):
    """No text is lost because another one bears its id."""
    a, b = "first " + " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(0, a), (1, a + " tail"), (1, b), (2, a), (None, b + " end"), (None, "short"), (None, "short"), (3, ""), (3, None), (4, b), (4, b)]
    got = mh.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = sorted(map(str, [(r.doc_id, r.component_id, r.kept, r.stays) for r in got.collect()]))
    want = [(0, 0, True, True), (1, 0, False, False), (1, 1, True, True), (2, 0, False, False), (None, 1, False, False), (None, None, True, True), (None, None, False, False)]
    want += [(3, 3, True, True)] * 2 + [(4, 1, False, False)] * 2
    assert seen == sorted(map(str, want))
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, near_set int")
    kept = mh.near_dedup_stage(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("0", a), ("1", b), ("3", ""), ("3", ""), ("None", "short")]


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, mh.SLOTS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(mh.SLOTS, mh.RADIUS, replace=False)
        b[at] += 1
        ka, kb = mh.keys_of(np.stack([a, b]))
        shared = np.flatnonzero(ka == kb)
        assert len(shared) and mh.first_shared_slot((a != b)[None])[0] == shared[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 60), (7, 7)]
    got = {r.node: r.component for r in mh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 100: 50}


@pytest.mark.parametrize("percent", [80, 83, 85, 90])
def test_radii_suit_the_similarity(percent):
    """A pair at the limit is missed seldom by either signature."""
    layout = mh.laid_out(percent)
    rng = np.random.default_rng(percent)
    for slots, radius, differs in ((mh.SLOTS, layout.radius, 1 - percent / 100), (mh.LONG, layout.long_radius, 0.75 * (1 - percent / 100))):
        assert (rng.binomial(slots, differs, 1_000_000) > radius).sum() <= 10
    assert layout.radius < 2 * len(layout.chunk_slots) and sum(layout.chunk_slots, []) == list(range(mh.SLOTS))


def pairs_at(percent, n, seed):
    """n pairs of texts that share exactly percent of their shingles: cut at both ends, nothing else is alike."""
    rng = np.random.default_rng(seed)
    for k in range(n):
        # two windows of one text of 200 shingles in all, percent of them in both
        words = [f"p{k}w{x}" for x in rng.permutation(204)]
        alone = 2 * (100 - percent)
        yield " ".join(words[: 204 - alone // 2]), " ".join(words[alone // 2 :])


def test_long_signature_passes_pairs_at_80():
    layout, far = mh.laid_out(80), 0
    for a, b in pairs_at(80, 300, 5):
        x, y = mh.shingle_hashes(a), mh.shingle_hashes(b)
        both = len(np.intersect1d(x, y))
        assert 100 * both == 80 * (len(x) + len(y) - both)
        long = [mh.long_signature(s).view(np.uint64)[None] for s in (x, y)]
        short = [mh.signature(s) for s in (x, y)]
        far += bool(mh.long_distance(*long)[0] > layout.long_radius or (short[0] != short[1]).sum() > layout.radius)
    assert far == 0


def test_near_at_80_equals_brute_force(spark, monkeypatch):
    """Without offers every link must pass the final search of the tiles."""
    monkeypatch.setattr(mh, "ROUNDS", 0)
    rows = near_rows(2)
    for a, b in pairs_at(80, 60, 6):
        rows += [(len(rows), a), (len(rows) + 1, b)]
    got = mh.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    want = brute(rows, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and want != brute(rows, 85)
