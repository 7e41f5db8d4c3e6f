"""Facts by a language model: batches, calls that fail, refining in rounds, and a refresh that goes on where it stopped."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tessera import plugins
from tessera.engine import Engine
from tessera.operators import facts

WHEN = "timestamp '2024-01-01'"


class Model:
    """Answers with each paragraph's first word; fails on paragraphs that hold a word, notes its calls in a folder."""

    def __init__(self, folder, bad="", brief=3):
        self.folder, self.bad, self.brief = str(folder), bad, brief

    def complete(self, prompt):
        listed = json.loads(prompt.rsplit("\n", 1)[1])
        with open(f"{self.folder}/calls-{os.getpid()}", "a") as log:
            log.write(json.dumps([r["id"] for r in listed]) + "\n")
        if self.bad and self.bad in prompt.rsplit("\n", 1)[1]:
            raise ValueError("refused")
        if prompt.startswith("Put these facts"):
            return json.dumps({"answer": [{"fact": r["fact"][: self.brief], "id": r["id"]} for r in listed]})
        return "Sure [1]: " + json.dumps({"answer": [{"fact": r["content"].split()[0] * 4, "id": r["id"]} for r in listed] + [{"fact": "made up", "id": 12}]})

    def calls(self):
        return [json.loads(x) for f in os.listdir(self.folder) if f.startswith("calls-") for x in open(f"{self.folder}/{f}")]


def documents(spark, texts):
    return spark.createDataFrame([(f"/d/{k}.md", t) for k, t in enumerate(texts)], "file_path string, markdown string").withColumn("modified", F.expr(WHEN))


def greedy(sizes, cap):
    out, total = [], 0
    for n in sizes:
        if out and total + n <= cap:
            out[-1] += 1
            total += n
        else:
            out.append(1)
            total = n
    return out


def test_batches_hold_neighbours_up_to_the_cap(spark):
    rows = spark.createDataFrame([(k % 2, k, "x" * (7 * k % 23 + 1)) for k in range(60)], "task_id int, para_id long, content string")
    got = facts.batched(rows, ["task_id"], 40).collect()
    for task in (0, 1):
        own = [[r["id"] for r in b.rows] for b in sorted(got, key=lambda b: (b.g, b.batch)) if b.task_id == task]
        assert sorted(i for b in own for i in b) == list(range(task, 60, 2))
        assert [len(b) for b in own] == greedy([7 * k % 23 + 1 for k in range(task, 60, 2)], 40)
    assert all(len(b.rows) == 1 for b in facts.batched(rows, ["task_id"], 0).collect())
    assert facts.batched(rows.limit(0), ["task_id"], 40).count() == 0


def test_groups_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(facts, "BATCHES", 2)
    rows = spark.createDataFrame([(k, "x" * 500) for k in range(100)], "para_id long, content string")
    assert 1 < facts.spread(rows, F.length("content"), 1_000).select("g").distinct().count() <= 25


def test_a_failing_call_is_a_row(spark, tmp_path):
    model = Model(tmp_path, "bad")
    rows = spark.createDataFrame([(0, [(1, "alpha")]), (1, [(2, "bad")])], "batch int, rows array<struct<id: long, content: string>>")
    got = facts.extract_with(plugins.extractor_of(plugins.Throttled(model, attempts=1)), rows, "q", attempts=2, delay=0.01).collect()
    got.sort(key=lambda r: r.batch)  # a sort by Spark would ask twice
    assert [(r.attempts, r.error and r.error[:10], r.cost > 0) for r in got] == [(1, None, True), (2, "ValueError", False)]
    assert sorted(model.calls()) == [[1], [2], [2]]


def test_deep_search_asks_the_model(spark, tmp_path):
    model = Model(tmp_path)
    engine = Engine(spark, str(tmp_path / "e"), model, buckets=2)
    engine.put(documents(spark, ["fox runs", "bear sleeps", "owl sees"]))
    strategy, got = engine.collect_facts("what does it do", "/d/")
    assert strategy == "NEW_QUESTION" and sorted(r.facts for r in got.collect()) == ["bear" * 4, "fox" * 4, "owl" * 4]
    assert len(model.calls()) == 1  # one batch of all three
    calls = engine.store.read("calls").collect()
    assert len(calls) == 1 and calls[0].task_id is None and calls[0].cost > 0 and calls[0].error is None and calls[0].question == "what does it do"
    brief = engine.answer("what does it do", "deepSearch", "/d/", budget=20).collect()
    assert sorted(r.facts for r in brief) == ["bea", "fox", "owl"]


def test_refresh_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    model = Model(tmp_path)
    engine = Engine(spark, str(tmp_path / "e"), model, buckets=4)
    engine.put(documents(spark, [f"w{k} text" for k in range(24)]))
    engine.create_task("/d", "which words")
    buckets = {r.bucket: r.n for r in engine.paragraphs().groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(buckets.values()) == 24 and len(buckets) == 4
    monkeypatch.setattr(Engine, "CALLS", 1)  # a commit a bucket
    commit, done = engine.store.commit, []

    def lost(changes, state=None):
        if "progress" in changes:
            if len(done) == 2:
                raise RuntimeError("lost")
            done.append(1)
        return commit(changes, state)

    monkeypatch.setattr(engine.store, "commit", lost)
    with pytest.raises(RuntimeError):
        engine.refresh_tasks()
    monkeypatch.setattr(engine.store, "commit", commit)
    assert engine.progress().first().status == "processing" and engine.facts().count() == buckets[0] + buckets[1]
    # a document that comes into a done bucket now is extracted at once, one of another bucket by the refresh
    engine.put(documents(spark, []).unionByName(spark.createDataFrame([(f"/d/late{k}.md", "late text") for k in range(6)], "file_path string, markdown string").withColumn("modified", F.expr(WHEN))))
    again = Engine(spark, str(tmp_path / "e"), model, buckets=4)
    again.refresh_tasks()
    asked = [i for c in model.calls() for i in c]
    twice = {i for i in asked if asked.count(i) > 1}
    assert len(set(asked)) == 30 and len(asked) - 30 == len(twice) <= buckets[2]  # only the bucket that was lost
    task = again.progress().first()
    assert (task.status, task.covered_file_count, task.facts, task.error) == ("active", 30, 30, None)
    assert task.full_cost + task.incremental_cost == sum(r.cost for r in again.store.read("calls").collect())
    before = len(model.calls())
    again.refresh_tasks()
    assert len(model.calls()) == before
    again.refresh_tasks(full=True)
    assert len(model.calls()) == before + 30 and again.facts().count() == 30


def test_a_task_with_a_failed_call_fails_and_recovers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(facts.extract_with, "__defaults__", (None, 1, 0.0))
    bad = Model(tmp_path, "w7 ")
    engine = Engine(spark, str(tmp_path / "e"), bad, buckets=3)
    engine.put(documents(spark, [f"w{k} text" for k in range(12)]))
    engine.create_task("/d", "which words")
    engine.refresh_tasks()
    task = engine.progress().first()
    assert task.status == "failed" and "refused" in task.error and 0 < task.facts < 12
    calls = engine.store.read("calls").collect()
    assert sum(c.error is not None for c in calls) == 1 and len(calls) == 12
    held = task.facts
    good = Engine(spark, str(tmp_path / "e"), Model(tmp_path), buckets=3)
    good.refresh_tasks()
    task = good.progress().first()
    assert (task.status, task.facts, task.error) == ("active", 12, None)
    assert len(good.store.read("calls").collect()) == 12 + (12 - held)


def test_similar_questions_are_asked_by_pages(spark):
    class Pages:
        def complete(self, prompt):
            ids = re.findall(r"^(\d+):", prompt, re.M)
            return "no" if "2" in ids else json.dumps([{"id": ids[0], "similarity": 90}])

    rows = spark.createDataFrame([(k, "what is red" if k == 3 else f"who {k}") for k in range(6)], "id long, question string")
    got = plugins.similar_with(Pages(), rows, "what is red", page=2).collect()
    assert [(r.id, r.similarity) for r in got] == [(3, 1.0), (0, 0.9), (4, 0.9)]  # the page that can't be read is measured offline
