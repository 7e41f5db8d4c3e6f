import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import catalog, chunk, facts, index, search, tables

# -- chunks and batches -----------------------------------------------------------------------

LINE = st.sampled_from(["# A", "## B", "### C d", "plain text here", "", "x" * 37, "##### E", "word " * 9])


@settings(max_examples=60, deadline=None)
@given(st.lists(LINE, max_size=60), st.integers(60, 200))
def test_chunks_lose_nothing(lines, size):
    content = "\n".join(lines)
    got = chunk.split_markdown(content, size)
    assert all(0 < len(c) <= size and c.strip() for c in got)
    if len(content) > size:
        title = chunk.document_title(content)
        lead = f"# {title}\n" if title else ""
        assert all(c.startswith(lead) for c in got[1:])
        bare = lambda s: "".join(s.split())
        assert bare("".join([got[0]] + [c[len(lead):] for c in got[1:]]) if got else "") == bare(content)


def test_chunk_frame(spark):
    rows = [(1, "# T\n" + "\n".join(f"## S{i}\n" + "w " * 40 for i in range(9))), (2, "short"), (3, None), (4, "  ")]
    got = chunk.chunks(spark.createDataFrame(rows, "doc_id long, text string"), 300).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(len(r.content) <= 300 for r in got)
    ords = sorted(r.ord for r in got if r.doc_id == 1)
    assert ords == list(range(len(ords))) and len(ords) > 2


def greedy(sizes, cap, sep, strict):
    out, k, total = [], -1, 0
    for n in sizes:
        joined = total + sep + n
        if k >= 0 and (joined < cap if strict else joined <= cap):
            total = joined
        else:
            k, total = k + 1, n
        out.append(k)
    return out


def test_batches_fold(spark):
    sizes = [5, 3, 9, 12, 1, 1, 8, 2, 10]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "g int, o int, n long")
    for sep, strict in ((0, False), (1, False), (0, True)):
        got = [r.batch for r in chunk.batches(rows, "g", "o", "n", 10, sep, strict).orderBy("o").collect()]
        assert got == greedy(sizes, 10, sep, strict)


# -- tables -----------------------------------------------------------------------------------


def test_published_versions(spark, tmp_path):
    t = tables.Published(spark, str(tmp_path / "t"))
    assert t.read("id int").count() == 0
    for n in (1, 2, 3):
        t.publish(t.read("id int").union(spark.createDataFrame([(n,)], "id int")))
    assert sorted(r.id for r in t.read("id int").collect()) == [1, 2, 3] and len(t.versions()) == 2


def test_null_ids_and_history(spark):
    rows = spark.createDataFrame([("1", 1), (None, 2), ("null", 3)], "id string, at int")
    left, removed = tables.delete_null_ids(rows, "id")
    assert [r.id for r in left.collect()] == ["1"] and removed.first().removed == 2
    assert [r.at for r in tables.page_back(rows, "at", 1, 2).collect()] == [1, 2]
    assert tables.clear_field(rows, "id", F.lit(None).cast("boolean")).filter("id = '1'").count() == 1


# -- catalog ----------------------------------------------------------------------------------


def test_ancestors_and_prefixes(spark):
    paths = spark.createDataFrame([("/a/b/c.md",), ("/a/bc/d.md",)], "file_path string")
    got = {r.file_path: r.a for r in paths.select("file_path", catalog.ancestors(F.col("file_path")).alias("a")).collect()}
    assert got["/a/b/c.md"] == ["/", "/a/", "/a/b/"]
    tasks = spark.createDataFrame([(1, "/a/b/")], "id long, directory_path string")
    assert [r.file_path for r in catalog.tasks_for_paths(paths, tasks).collect()] == ["/a/b/c.md"]


def test_suggestions(spark):
    names = "/usr/local/abc /usr/local/edf /usr/search/local/abc /local/usr/dev/test /chain/level1/level2/level3/end1 /chain/level1/level2/level3/end2 /chain/level1/level2/level3/".split()
    rows = spark.createDataFrame(list(enumerate(names)), "seq int, path string")
    got = [r.path for r in catalog.suggest_paths(rows, "/chain").orderBy("rank").collect()]
    assert got == [names[6], names[4], names[5]]


def test_worker_pages_part_the_work(spark):
    rows = spark.createDataFrame([(i, f"n{i}", "file_saved") for i in range(30)], "id long, file_name string, state string")
    seen = [r.id for w in range(4) for r in catalog.worker_page(rows, w, size=30).collect()]
    assert sorted(seen) == list(range(30))


# -- search -----------------------------------------------------------------------------------

DOCS = [(1, "the red fox runs"), (2, "red fox"), (3, "fox the red"), (4, "red big fast fox"), (5, None), (6, "")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_phrase_slop(spark):
    counted = search.with_terms(docs(spark), ["red", "fox"], positions=True).withColumn("pf", search.phrase_frequency(["pos_0", "pos_1"]))
    assert {r.doc_id: round(r.pf, 4) for r in counted.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: round(1 / 3, 4), 5: 0.0, 6: 0.0}


def sloppy(tokens, words, slop=search.SLOP):
    """Frequency by trying every choice of places: the narrowest window of each start."""
    import itertools

    best = {}
    for at in itertools.product(*([k for k, t in enumerate(tokens) if t == w] for w in words)):
        moved = [p - k for k, p in enumerate(at)]
        if len(set(at)) == len(at):
            best[min(moved)] = min(best.get(min(moved), 99), max(moved) - min(moved))
    return sum(1 / (1 + n) for n in best.values() if n <= slop)


def test_two_word_phrases_equal_brute_force(spark):
    import random

    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(300)] + ["a b b", "b a", "a a b b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = search.with_terms(rows, ["a", "b"], positions=True).withColumn("pf", search.phrase_frequency(["pos_0", "pos_1"]))
    for row in counted.collect():
        tokens = texts[row.doc_id].split()
        # a start whose window holds a later start of its word isn't the narrowest one
        assert row.pf <= sloppy(tokens, ["a", "b"]) + 1e-9 and (row.pf > 0) == (sloppy(tokens, ["a", "b"]) > 0)
    exact = {texts[r.doc_id]: r.pf for r in counted.collect()}
    assert exact["a b b"] == 1.0 and exact["b a"] == 1 / 3
    three = search.with_terms(spark.createDataFrame([(1, "x y z"), (2, "x z y"), (3, "x q y z"), (4, "x y")], "doc_id long, text string"), ["x", "y", "z"], positions=True)
    got = {r.doc_id: round(r.pf, 4) for r in three.withColumn("pf", search.phrase_frequency(["pos_0", "pos_1", "pos_2"])).collect()}
    assert got == {1: 1.0, 2: round(1 / 3, 4), 3: 0.5, 4: 0.0}


def test_index_equals_scan(spark, tmp_path):
    own = docs(spark)
    idx = index.TextIndex(spark, str(tmp_path / "i"), buckets=4)
    idx.build(own)
    scan = {r.doc_id: round(r.score, 9) for r in search.bm25(own, ["red", "runs"]).collect()}
    scores = lambda df: {r.doc_id: round(r.score, 9) for r in df.collect()}
    assert scores(idx.bm25(["red", "runs"])) == scan
    query = search.SearchQuery(exact=("red fox",), required=("the",), optional=("big",))
    assert scores(idx.strategy(query)) == scores(search.strategy(own, query)) and len(scores(idx.strategy(query))) == 4
    for q in ("red foxx", 'the AND "red fox"', "ru* NOT big", '"fox the"', "AND", 'a"', None, "fox OR bigg"):
        assert scores(idx.fallback(q)) == scores(search.fallback(search.Scan(own), q)), q
    assert set(scores(idx.fallback('the AND "red fox"'))) == {1} and scores(idx.fallback("AND")) == {}
    assert idx.statistics().first().terms == 6
    plan = idx.of_terms(["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_index_updates(spark, tmp_path):
    idx = index.TextIndex(spark, str(tmp_path / "i"), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    idx.build(docs(spark))
    held = dict(DOCS)
    idx.update(frame([(2, "blue fox"), (9, "blue whale")]))
    idx.delete(frame([(1, "")]))
    held |= {2: "blue fox", 9: "blue whale"}
    del held[1]
    for k in range(7):  # enough updates to have the tables written anew
        idx.update(frame([(9, f"blue whale {'sings ' * k}")]))
        held[9] = f"blue whale {'sings ' * k}"
    want = {r.doc_id: round(r.score, 9) for r in search.bm25(frame(list(held.items())), ["blue", "fox", "runs", "sings"]).collect()}
    assert {r.doc_id: round(r.score, 9) for r in idx.bm25(["blue", "fox", "runs", "sings"]).collect()} == want
    assert {r.doc_id for r in idx.fallback("runs").collect()} == set()  # the only document with "runs" went
    now = [0.0]
    c = index.Committer(idx, lambda: now[0])
    before = idx.store.state()[0]
    for k in range(49):
        c.put(100 + k, "zebra")
    assert idx.store.state()[0] == before
    c.delete(100)
    assert idx.store.state()[0] == before + 1 and idx.bm25(["zebra"]).count() == 48
    c.put(300, "zebra")
    now[0] = 6.0
    assert c.tick() and idx.bm25(["zebra"]).count() == 49


def test_commits_are_whole_and_exclusive(spark, tmp_path, monkeypatch):
    make = lambda n: spark.createDataFrame([(n, "x")], "id int, v string")
    store = tables.Store(spark, str(tmp_path / "s"), {k: tables.Table("id INT, v STRING", "id") for k in "ab"})
    start = store.state()
    store.commit({"a": tables.Change(make(1)), "b": tables.Change(make(1))}, start)
    with pytest.raises(tables.ConcurrentCommit):
        store.commit({"a": tables.Change(make(2))}, start)
    assert [store.read(k).count() for k in "ab"] == [1, 1]
    broken = make(3).withColumn("v", F.expr("cast(raise_error('no') AS string)"))
    with pytest.raises(Exception, match="no"):
        store.commit({"a": tables.Change(make(5)), "b": tables.Change(broken)})
    assert [r.id for r in store.read("a").collect()] == [1]
    monkeypatch.setattr(tables.Store, "MERGE", 3)
    held = {1: "x"}
    for k in range(14):  # rows come, are replaced, go and come again, over merges of several levels
        new = spark.createDataFrame([(k, f"v{k}"), (k % 4, f"w{k}")], "id int, v string").dropDuplicates(["id"])
        gone = spark.createDataFrame([(k,), (k % 4,), (k - 5,)], "id int")
        held = {i: v for i, v in held.items() if i not in (k, k % 4, k - 5)} | {r.id: r.v for r in new.collect()}
        store.commit({"a": tables.Change(new, gone)})
        assert {r.id: r.v for r in store.read("a").collect()} == held and store.read("a").count() == len(held)
    parts = store.state()[1]["a"]
    assert len(parts["segments"]) <= 6 and len(parts["gone"]) < 3 and max(x[2] for x in parts["segments"]) == 2


def test_stems_and_scripts(spark):
    from tessera.functions import analysis

    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
             "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper", "hopefulness": "hope",
             "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control"}
    assert {w: analysis.stem(w) for w in known} == known
    assert analysis.analyze("搜索引擎 engines, 中 été") == ["搜索", "索引", "引擎", "engin", "中", "été"]
    rows = spark.createDataFrame([(1, "全文搜索引擎"), (2, "searching engines"), (3, None)], "doc_id long, text string")
    source = search.Scan(rows, analyzer=search.STEMMED)
    find = lambda q: {r.doc_id for r in search.fallback(source, q, search.STEMMED).collect()}
    assert find("搜索") == {1} and find("searched engine") == {2}


def test_empty_and_rewritten_queries(spark):
    assert search.strategy(docs(spark), search.SearchQuery()).count() == 0
    assert search.fuzzy(docs(spark), " , ").count() == 0
    q = search.rewrite('what is "red fox" in the last 7 days running')
    assert q.exact == ("red fox",) and q.last_n_days == 7 and "running" in q.required and "is" in q.optional
    assert search.queries_of("a\n\n b \na", "q") == ["q", "a", "b"]


# -- facts ------------------------------------------------------------------------------------


def test_external_extractor(spark):
    rows = spark.createDataFrame([(0, [(1, "alpha")]), (1, [(2, "bad")])], "batch long, rows array<struct<id: long, content: string>>")

    def extractor(batch, question):
        if batch[0][1] == "bad":
            raise ValueError("no")
        return '{"answer": [{"fact": "%s", "id": "%d"}]}' % (batch[0][1], batch[0][0])

    got = facts.extract_with(extractor, rows, "q").orderBy("batch").collect()
    assert got[0].error is None and got[0].cost == 5 + 1 + len(got[0].response) and "ValueError" in got[1].error
    assert [(r.para_id, r.fact) for r in facts.parsed(facts.extract_with(extractor, rows, "q")).collect()] == [(1, "alpha")]


def test_reduce_stops_within_budget(spark):
    rows = spark.createDataFrame([(k, 0, "x" * 10) for k in range(10)], "para_id long, seq int, fact string")
    halve = lambda b: b.filter("para_id % 2 = 0").select((F.col("para_id") / 2).cast("long").alias("para_id"), "seq", "fact")
    assert facts.reduce_facts(rows, halve, budget=30).count() == 3
    assert facts.reduce_facts(rows, halve, budget=1000).count() == 10


def test_all_postings_are_made_within_rows(spark):
    texts = ["b a b", "", None, "a" * 70 + " x a x", "one two three two one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = index.postings(rows, 4)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, t in enumerate(texts):
        words = (t or "").split()
        want |= {(i, w, words.count(w), len(words), tuple(k for k, x in enumerate(words) if x == w), index.bucket_number(w, 4)) for w in words}
    got = [(r.doc_id, r.term, r.tf, r.dl, tuple(r.positions), r.bucket) for r in made.collect()]
    assert set(got) == want and len(got) == len(want)


def test_files_of_an_index_grow_with_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.Store, "ROWS", 20, raising=False)
    rows = spark.range(120).selectExpr("id AS doc_id", "concat_ws(' ', 'all', 'of', 'them', 'word' || (100 + id), 'more' || id % 7) AS text")
    own = index.TextIndex(spark, str(tmp_path / "i"), 4)
    own.build(rows)
    for name in ("postings", "neighbours"):
        files = own.store.read(name).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bucket").alias("buckets"))
        most, buckets = files.agg(F.max("n"), F.max("buckets")).first()
        assert most <= 80 and buckets == 1  # buckets differ, and their rows are dealt by a hash: some files get more
    assert {(r.doc_id, r.term) for r in own.store.read("postings").collect()} == {(r.doc_id, t) for r in rows.collect() for t in r.text.split()}


def test_places_are_shuffled_in_two_bytes_where_they_fit(spark):
    long = " ".join(["a", "b"] * (1 << 14) + ["c"])
    rows = spark.createDataFrame([(0, "b a b"), (1, long)], "doc_id long, text string")
    packed = index.blocks(rows, 2)
    assert dict(packed.dtypes)["places"] == "array<smallint>"
    got = {(r.doc_id, r.term): r.positions for r in index.opened(packed).collect()}
    assert got[0, "b"] == [0, 2] and got[1, "c"] == [1 << 15] and got[1, "b"] == list(range(1, 1 << 15, 2))


def test_texts_of_paragraphs_are_not_shuffled(spark, tmp_path, monkeypatch):
    own = Engine(spark, str(tmp_path / "e"), buckets=4)
    dealt = []
    for name in ("repartition", "repartitionById"):
        was = getattr(type(own.paragraphs()), name)
        monkeypatch.setattr(type(own.paragraphs()), name, lambda self, *a, was=was: dealt.append(self.columns) or was(self, *a))
    para = spark.range(40).select(F.col("id").alias("para_id"), F.col("id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("text").alias("content"), own.bucket("id").alias("bucket"))
    own.store.commit({"paragraphs": tables.Change(para)})
    assert not dealt and own.paragraphs().count() == 40


def test_simple_search_shuffles_no_texts(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "e"), analyzer=search.LATIN, buckets=4)
    rows = [(f"/d/{k}.txt", ("fox " if k % 3 == 0 else "hen ") * (1 + k % 7)) for k in range(40)]
    own.put(spark.createDataFrame(rows, "file_path string, markdown string").withColumn("modified", F.to_timestamp(F.lit("2024-01-01"))))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the planner couldn't tell that few paragraphs are wanted
    try:
        hits = own.simple_search("fox", "/d", 5)
        plan = hits._jdf.queryExecution().sparkPlan().toString()
        got = [(r["rank"], r.file_path) for r in hits.orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    texts = [line for line in plan.splitlines() if "Join" in line][0]  # the outermost join is the one with the texts
    assert "BroadcastHashJoin" in texts
    assert [k for k, _ in got] == [1, 2, 3, 4, 5] and {p for _, p in got} <= {p for p, t in rows if "fox" in t}
