"""Words of scripts without blanks, and terms near a term by shared keys."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import analysis, segmentation
from tessera.functions.segmentation import Segmenter, cut
from tessera.operators import index, search, words
from tessera.operators.tables import Change, Store, Table
from tessera.plans import search as plan


def all_cuts(run):
    for marks in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        out, last = [], 0
        for k, m in enumerate(marks, 1):
            if m:
                out.append(run[last:k])
                last = k
        yield [*out, run[last:]] if run else []


def log_of(cutter, parts):
    return sum(cutter.logs.get(w, cutter.unseen if len(w) == 1 else -math.inf) for w in parts)


def test_best_and_expected_equal_all_cuts():
    r = random.Random(5)
    for _ in range(150):
        known = {"".join(r.choice("春夏秋冬") for _ in range(r.randint(1, 3))): r.randint(1, 50) for _ in range(r.randint(0, 12))}
        cutter = Segmenter(known)
        run = "".join(r.choice("春夏秋冬外") for _ in range(r.randint(0, 9)))
        cuts = [(log_of(cutter, c), c) for c in all_cuts(run)]
        best = cutter.best(run)
        assert "".join(best) == run and math.isclose(log_of(cutter, best), max(x for x, _ in cuts), abs_tol=1e-9)
        total, want = sum(math.exp(x) for x, _ in cuts), {}
        for x, c in cuts:
            for w in c:
                want[w] = want.get(w, 0) + math.exp(x) / total
        got = cutter.expected(run)
        assert all(math.isclose(got.get(w, 0), n, abs_tol=1e-9) for w, n in want.items()) and all(w in want for w in got)


def test_long_runs_do_not_underflow():
    cutter = Segmenter({"ab": 3, "a": 1, "b": 1})
    run = "ab" * 4000
    assert cutter.best(run) == ["ab"] * 4000 and sum(len(w) * n for w, n in cutter.expected(run).items()) == pytest.approx(8000)


LEXICON = ["北京", "大学", "学生", "生活", "图书馆", "中国", "人民", "银行", "喜欢", "我们", "在", "的", "去", "看"]


def made(n, seed=2):
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(LEXICON))]
    return [r.choices(LEXICON, weights, k=r.randint(3, 9)) for _ in range(n)]


def test_words_are_learned_from_runs(spark):
    sentences = made(1500)
    rows = spark.createDataFrame([("。".join("".join(s) for s in sentences[k : k + 5]),) for k in range(0, 1500, 5)] + [(None,), ("",), ("latin only",)], "text string")
    known = words.learn(rows)
    cutter = Segmenter(known)
    right = sum(cutter.best("".join(s)) == s for s in made(300, 9))
    assert right > 240, right
    assert words.learn(rows.filter("text IS NULL OR text = ''")) == {}
    assert len(words.learn(rows, vocabulary=12)) <= 12


def test_runs_and_substrings_equal_brute_force(spark):
    texts = ["春夏春夏 x 春", "夏", None, "春夏春夏", "秋" * 600]
    got = {r.run: r.n for r in words.runs(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {"春夏春夏": 2, "春": 1, "夏": 1, "秋" * 256: 2, "秋" * 88: 1}
    want = {}
    for run, n in got.items():
        for i in range(len(run)):
            for j in range(i + 1, min(len(run), i + 4) + 1):
                want[run[i:j]] = want.get(run[i:j], 0) + n
    counted = spark.createDataFrame(list(got.items()), "run string, n long")
    assert {r.word: r.n for r in words.substrings(counted).collect()} == want
    total = sum(n for w, n in want.items() if len(w) == 1)
    ratio = lambda w: min(want[w] * total / (want[w[:k]] * want[w[k:]]) for k in range(1, len(w)))
    good = {w: n for w, n in want.items() if len(w) == 1 or n >= 2 and ratio(w) >= 1.5}
    assert {r.word: r.n for r in words.cohesive(words.substrings(spark.createDataFrame(list(got.items()), "run string, n long")), 2, 1.5).collect()} == good
    # a round of expectation over Spark's partitions is the sum over runs
    cutter, sums = Segmenter({"春夏": 3.0, "春": 1.0, "夏": 1.0, "秋": 2.0}), {}
    for run, n in got.items():
        for w, share in cutter.expected(run).items():
            sums[w] = sums.get(w, 0) + n * share
    found = {r.word: r.n for r in words.expected(counted.repartition(3), {"春夏": 3.0, "春": 1.0, "夏": 1.0, "秋": 2.0}).collect()}
    assert found == pytest.approx(sums, abs=1e-4)


def test_analyzer_of_words_keeps_positions(spark):
    own = search.segmented({"中国": 5.0, "人民": 5.0, "银行": 4.0, "民银": 0.01})
    assert own.query("I saw 中国人民银行 Running") == ["i", "saw", "中国", "人民", "银行", "run"]
    got = spark.createDataFrame([("x 中国人民银行 y",), (None,)], "t string").select(own.column(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [["x", "中国", "人民", "银行", "y"], []]
    assert search.segmented({}) is search.STEMMED and analysis.analyze("中国人") == ["中国", "国人"]
    runs = spark.createDataFrame([("ab。c",), (None,)], "t string").select(cut(F.col("t"), {"ab": 2.0}, "[a-z]+").alias("t")).collect()
    assert [r.t for r in runs] == [["ab", "c"], []]


def test_an_engine_learns_its_words(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), buckets=2)
    texts = ["。".join("".join(s) for s in made(40, k)) for k in range(30)] + ["我们去中国人民银行"]
    rows = [(f"/d/{k}.txt", t) for k, t in enumerate(texts)]
    engine.put(spark.createDataFrame(rows, "file_path string, markdown string").withColumn("modified", F.to_timestamp(F.lit("2024-01-01"))))
    assert engine.learn_words() > 14
    last = engine.index.of_terms(["银行"]).withColumnRenamed("doc_id", "para_id").join(engine.paragraphs().filter("content LIKE '我们去中国%'"), "para_id").collect()
    assert [r.positions for r in last] == [[4]]
    again = Engine(spark, str(tmp_path / "e"), buckets=2)
    assert again.analyzer.query("中国人民银行") == ["中国", "人民", "银行"]
    assert again.index.bm25(again.analyzer.query("银行")).count() == sum("银行" in t for t in texts)


# -- neighbours -------------------------------------------------------------------------------


def edited(r, term):
    for _ in range(r.randint(0, 3)):
        k = r.randint(0, len(term))
        term = r.choice([term[:k] + r.choice("abé") + term[k:], term[:k] + term[k + 1 :], term[:k] + r.choice("abé") + term[k + 1 :]])
    return term


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_terms_share_a_key(spark):
    r = random.Random(1)
    asked = ["".join(r.choice("ab") for _ in range(n)) for n in (1, 2, 3, 7, 10, 11, 12, 13, 14, 15, 16, 30, 90)]
    terms = sorted({edited(r, a) for a in asked for _ in range(60)} - {""})
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select("term", index.keys_of(F.col("term")).alias("keys")).collect()
    kept = {r.term: set(r.keys) for r in rows}
    assert max(map(len, kept.values())) <= 1 + 12 + 66
    for a in asked:
        keys = index.keys_near(a)
        for t in terms:
            if levenshtein(a, t) <= index.EDITS:
                assert keys & kept[t], (a, t)


def test_near_equals_the_whole_dictionary(spark, tmp_path):
    r = random.Random(7)
    base = ["licence", "released", "a", "internationalisation", "ab"]
    docs = [(k, " ".join(edited(r, r.choice(base)) for _ in range(30))) for k in range(40)]
    own = index.TextIndex(spark, str(tmp_path / "i"), 4)
    own.build(spark.createDataFrame(docs, "doc_id long, text string"))
    own.update(spark.createDataFrame([(99, "licence licences released")], "doc_id long, text string"))
    terms = [r.term for r in own.store.read("terms").select("term").distinct().collect()]
    for a in [*base, "", "zzzzzz"]:
        for edits in (0, 1, 2):
            want = sorted((levenshtein(a, t), t) for t in terms if levenshtein(a, t) <= edits)
            assert sorted((x.d, x.term) for x in own.near(a, edits).collect()) == want
    plan = own.near("licence", 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(ValueError):
        own.near("a", 3)


def test_buckets_need_no_job(spark):
    values = ["", "a", "é", "licence", "x" * 100, "中国"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", index.bucket_of(F.col("v"), 64).alias("b")).collect()
    assert {r.v: r.b for r in got} == {v: index.bucket_number(v, 64) for v in values}


def test_statistics_before_and_after_removal(spark, tmp_path):
    own = index.TextIndex(spark, str(tmp_path / "i"), 2)
    own.build(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id long, text string"))
    assert tuple(own.statistics().select("documents", "terms", "total_tf").first()) == (3, 2, 3)
    own.update(spark.createDataFrame([(4, "a c")], "doc_id long, text string"))
    own.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert tuple(own.statistics().select("documents", "terms", "total_tf").first()) == (3, 2, 2)


# -- readers and writers ----------------------------------------------------------------------


def test_a_reader_outlives_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": Table("id LONG", "id")})
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    store.commit({"t": Change(rows(1, 2))})
    reader = store.read("t")
    for k in range(12):
        store.commit({"t": Change(rows(100 + k), rows(99 + k), everything=k == 3)})
    assert sorted(r.id for r in reader.collect()) == [1, 2]
    store.keep = 0
    store.commit({"t": Change(rows(7))})
    assert len(store._manifests()) == 2
    assert len(list((tmp_path / "s").glob("t/rows-*"))) == len({p for n in store._manifests() for p, *_ in store._load(n)["t"]["segments"]})


def test_rows_of_written_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": Table("id LONG", "id"), "n": Table("n LONG", "n")})
    store.commit({"t": Change(spark.range(5)), "n": Change(lambda written: written["t"].agg(F.count("id").alias("n")))})
    assert [r.n for r in store.read("n").collect()] == [5]


def test_expected_counts_of_many_runs_at_once():
    r = random.Random(5)
    cutter = Segmenter({"a": 3.0, "b": 2.0, "ab": 4.0, "abc": 1.5, "cc": 2.0})
    cutter.TOGETHER = 7
    runs = ["".join(r.choice("abcd") for _ in range(r.randint(1, 40))) for _ in range(50)] + ["d", "dd", "é🙂"]
    want: dict[str, float] = {}
    for k, run in enumerate(runs):
        for word, share in cutter.expected(run).items():
            want[word] = want.get(word, 0.0) + (k + 1) * share
    got = cutter.expected_sums(runs, [k + 1 for k in range(len(runs))])
    assert {w for w, n in want.items() if n} == set(got) and all(abs(got[w] - want[w]) < 1e-9 * max(1, want[w]) for w in got)
    assert cutter.expected_sums([], []) == {}


def test_breaks_of_many_runs_equal_best_of_each():
    r = random.Random(3)
    for trial in range(40):
        letters = "春夏ab🙂é"[: r.randint(1, 6)]
        known = {"".join(r.choice(letters) for _ in range(r.randint(1, 5))): r.choice([0.5, 1, 2, 2, 4, 50]) for _ in range(r.randint(0, 15))}
        groups = [["".join(r.choice(letters + "x") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 4))] for _ in range(12)]
        runs = [run for g in groups for run in g]
        cutter = Segmenter(known)
        cutter.FEW, cutter.TOGETHER = r.choice([1, 12]), r.choice([3, 1_024])
        whole, ends = "".join(runs), [0, *(np.flatnonzero(cutter.breaks(runs)) + 1).tolist()]
        assert [whole[a:b] for a, b in zip(ends, ends[1:])] == [w for run in runs for w in cutter.best(run)]
        assert segmentation._lists(cutter, groups).to_pylist() == [[w for run in g for w in cutter.best(run)] for g in groups]
        found = {w: n for some, counts in segmentation.substring_counts(runs, [k + 1 for k in range(len(runs))], 4) for w, n in zip(some, counts)}
        want: dict[str, float] = {}
        for k, run in enumerate(runs):
            for i in range(len(run)):
                for j in range(i + 1, min(len(run), i + 4) + 1):
                    want[run[i:j]] = want.get(run[i:j], 0) + k + 1
        assert found == want


def test_sums_of_probabilities_do_not_underflow(monkeypatch):
    r = random.Random(8)
    known = {"a": 1.0, "b": 1e9, "ab": 3.0, "bab": 2.0}
    runs = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 256, 256, 2_000)]
    want: dict[str, float] = {}
    for run in runs:
        for w, n in Segmenter(known).expected(run).items():
            want[w] = want.get(w, 0.0) + n
    for table in (segmentation.Lattice.TABLE, 0):
        monkeypatch.setattr(segmentation.Lattice, "TABLE", table)
        assert Segmenter(known).expected_sums(runs, [1] * len(runs)) == pytest.approx(want, rel=1e-6)
    tiny = Segmenter({"a": 1.0, "b": 1e30, "ab": 5.0})  # below what is summed up in probabilities
    assert tiny.expected_sums(["aab", "c"], [2, 1]) == pytest.approx({w: n * k for run, k in (("aab", 2), ("c", 1)) for w, n in tiny.expected(run).items() if n})


def test_the_same_words_in_another_order_are_equally_likely():
    r = random.Random(4)
    for _ in range(200):
        cutter = Segmenter({"d": r.random(), "e": r.random(), "r": r.random(), "derder": 10 * r.random(), "x": 100 * r.random()})
        assert cutter.best("derder" + "der") in (["d", "e", "r", "derder"], list("derderder"))


def test_substrings_are_counted_once(spark, monkeypatch):
    """They were counted anew for each of the joins that read them."""
    rows = spark.createDataFrame([("".join(s),) for s in made(200)], "text string")
    counted, read = words.substrings, spark.sparkContext.accumulator(0)

    def watched(*args, **options):
        def run(frames):
            for frame in frames:
                read.add(len(frame))
                yield frame

        return counted(*args, **options).mapInPandas(run, "word string, n double")

    monkeypatch.setattr(words, "substrings", watched)
    words.learn(rows)
    assert read.value == counted(words.runs(rows)).count()


def test_runs_are_found_between_all_other_characters(spark):
    rows = spark.createDataFrame([("".join(chr(x) for x in range(c, c + 4_096) if not 0xD800 <= x < 0xE000),) for c in range(0, 0x110000, 4_096)], "t string")
    left = rows.select(F.regexp_replace("t", plan.BETWEEN, "").alias("t")).filter("t <> ''").collect()
    assert [r.t for r in left] == ["\n,." + "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xE0, 0x100))) + "œ"]
