import pytest
from pyspark.sql import functions as F

from tessera import plugins
from tessera.engine import Engine
from tessera.jobs import Jobs
from tessera.operators import search


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("corpus")
    (r / "a").mkdir()
    (r / "a" / "fox.md").write_text("# Fox\nThe red fox runs. A fox is an animal.")
    (r / "a" / "bear.md").write_text("# Bear\nThe brown bear sleeps. A bear is a large animal.")
    (r / "x.swp").write_text("ignored")
    return r


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), buckets=4)
    e.ingest(str(root))
    return e


def test_search_and_content(engine, root):
    hits = engine.search('"red fox" animal').collect()
    assert [h.title for h in hits] == ["fox.md", "bear.md"] and "<B>red</B> <B>fox</B>" in hits[0].snippet and hits[0].url == f"{root}/a/fox.md"
    content = engine.fetch_content([hits[1].para_id, 5, hits[0].para_id]).collect()
    assert "brown" in content[0].content and content[1].content == "" and "red" in content[2].content
    assert engine.search("zebra").count() == 0 and engine.search(search.SearchQuery()).count() == 0
    assert "<em>fox</em>" in engine.simple_search("fox").first().snippet
    prompt = engine.answer("fox animal").first()
    assert prompt.documents == 2 and prompt.prompt.startswith("## fox.md")
    assert engine.answer("fox", "search", f"{root}/b").count() == 0


def test_tasks_and_changes(engine, root):
    import os

    where = f"{root}/a/"
    assert engine.collect_facts("large animal", where)[0] == "NEW_QUESTION"
    engine.create_task(where, "large animal")
    engine.create_task(where, "large animal")
    assert engine.has_task(where) and not engine.has_task(f"{root}/b")
    engine.refresh_tasks()
    task = engine.tasks().first()
    assert engine.tasks().count() == 1 and (task.status, task.covered_file_count, task.hit_count, task.incremental_cost) == ("active", 2, 0, 0)
    assert task.checkpoint == engine.index.buckets and task.full_cost > 0
    strategy, got = engine.collect_facts("large animal", where)
    assert strategy == "SIMILAR_QUESTION" and got.count() == 2 and engine.tasks().first().hit_count == 1
    assert engine.collect_facts("fox", f"{root}/a/fox.md")[0] == "DIRECT_CONTENT"
    assert engine.ingest(str(root)).count() == 0
    (root / "a" / "fox.md").write_text("# Fox\nNothing here.")
    (root / "a" / "bear.md").unlink()
    (root / "a" / "new.md").write_text("a large animal")
    os.utime(root / "a" / "fox.md", (2_000_000_000, 2_000_000_000))
    told = []
    engine.listeners.append(lambda event, changes: told.append((event, changes.count())))
    changes = {r.file_path.rpartition("/")[2]: r.op for r in engine.ingest(str(root)).collect()}
    assert changes == {"fox.md": "modify", "bear.md": "delete", "new.md": "create"} and told == [("before_change", 3), ("after_change", 3)]
    engine.listeners.clear()
    # facts, counters and index are kept up to date without a refresh
    facts = [r.fact for r in engine.facts().collect()]
    task = engine.tasks().first()
    assert len(facts) == 1 and "large animal" in facts[0] and task.covered_file_count == 2 and task.incremental_cost > 0
    assert engine.search("bears").count() == 0 and [h.title for h in engine.search("animals").collect()] == ["new.md"]
    assert engine.progress().first().facts == 1
    job = engine.submit_facts("nothing", where)
    while (state := engine.jobs.poll(job)).status == "running":
        pass
    assert state.status == "done" and len(state.result) == 1 and engine.jobs.poll(job) is None
    os.utime(root / "a" / "fox.md", (2_000_000_100, 2_000_000_100))
    assert [r.op for r in engine.ingest(str(root)).collect()] == ["touch"]


def test_ignore_rules_are_applied_again(engine, root):
    assert {(r.file_path.rpartition("/")[2], r.op) for r in engine.reapply_ignore(["new.md"], str(root)).collect()} == {("new.md", "ignore")}
    assert engine.search("animal").count() == 0 and engine.facts().count() == 0
    assert engine.reapply_ignore(["new.md"], str(root)).count() == 0
    assert {r.op for r in engine.reapply_ignore([], str(root)).collect()} == {"restore"}
    assert [r.op for r in engine.ingest(str(root)).collect()] == ["modify"] and engine.search("animal").count() == 1


def test_a_failed_ingest_leaves_nothing(engine, root, monkeypatch):
    from tessera.operators import tables

    (root / "b").mkdir()
    path = engine.upload(f"{root}/b", "late.md", b"a late document")
    before = engine.store.state()

    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "create_exclusively", fail)
    assert engine.sync([str(root)]).first().failed == [str(root)]
    assert engine.store.state() == before
    monkeypatch.undo()
    summary = engine.sync([str(root)]).first()
    assert (summary.total, summary.success, summary.failed) == (1, 1, [])
    ids = [r.para_id for r in engine.paragraphs().collect()]
    assert len(ids) == len(set(ids)) and engine.search("late").first().url == path


def test_deletions(engine, root):
    where = f"{root}/a/"
    engine.delete(F.col("file_path").endswith("new.md"))
    assert engine.facts().count() == 0 and engine.documents().count() == 2 and engine.tasks().first().covered_file_count == 1
    engine.delete_task(engine.tasks().first().id)
    assert engine.tasks().count() == 0 and engine.paths().count() > 0 and engine.suggest_paths("fox").count() == 1
    assert engine.directory_status([where]).first().rate == "100.0%"


def test_settings(engine):
    engine.set("n", "1")
    engine.set("n", "2")
    assert engine.get("n", "int", 9) == 2 and engine.get("m", "int", 9) == 9


def test_job_failure_and_cancel(spark):
    jobs = Jobs(spark, 1)
    bad = jobs.submit(lambda: 1 / 0)
    while (state := jobs.poll(bad)).status == "running":
        pass
    assert state.status == "failed" and "ZeroDivisionError" in state.error
    slow = jobs.submit(lambda: spark.range(10**11).selectExpr("sum(sqrt(id))").collect())
    assert jobs.cancel(slow) and jobs.poll(slow).status == "cancelled" and not jobs.cancel(slow)


class Model:
    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, prompt):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_plugins():
    waits = []
    assert plugins.Throttled(Model(ValueError(), ValueError(), "ok"), sleep=waits.append).complete("x") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        plugins.Throttled(Model(*[ValueError()] * 3), sleep=waits.append).complete("x")
    q = plugins.rewrite_with(Model('so: {"required": ["a"], "lastNDays": 3}'), "question")
    assert q.required == ("a",) and q.last_n_days == 3
    assert plugins.rewrite_with(Model("nothing"), "red fox").required == ("red", "fox")
    with pytest.raises(TypeError):
        plugins.Registry().register("/a", object())
    now = [0.0]
    cache = plugins.Expiring(iter(range(9)).__next__, 30, lambda: now[0])
    assert (cache.get(), cache.get()) == (0, 0)
    now[0] = 31
    assert cache.get() == 1


def test_model_backed_parts(spark):
    hits = spark.createDataFrame([(1, 7, "red fox"), (2, 9, "brown bear")], "rank int, doc_id long, content string")
    ids = lambda *answers: plugins.rerank_with(Model(*answers), hits, "bear").first().ids
    assert ids(ValueError(), "no list", "[9, 7]") == [9, 7] and ids("a", "b", "c") == [7, 9]
    asked = spark.createDataFrame([(1, "what is red"), (2, "who is blue")], "id long, question string")
    got = plugins.similar_with(Model('[{"id": 2, "similarity": 90}, {"id": 1, "similarity": 60}]'), asked, "blue who").collect()
    assert [(r.id, r.similarity) for r in got] == [(2, 0.9)]
    assert [r.id for r in plugins.similar_with(Model("x", "y", "z"), asked, "what is red").collect()] == [1]


class Handler:
    def __init__(self, config):
        self.config = config

    rewrite = search = rerank = content = paths = collect_facts = lambda self, *a: None


def test_templates(spark):
    t = plugins.Templates(plugins.Registry())
    t.add("good", Handler)
    t.add("bare", lambda config: object())
    instances = spark.createDataFrame([("/a", "good", '{"n": 1}'), ("/b", "none", None), ("/c", "bare", None), ("/d", "good", "{")], "path_prefix string, template_id string, config string")
    with pytest.warns(UserWarning):
        assert t.load(instances) == ["/a"]
    assert t.registry.of("/a/x").config == {"n": 1}
    assert not t.remove("good", instances) and t.remove("good", instances.limit(0))
