"""Answers: several ways to ask, sources, handlers by path; registered folders."""

import pytest
from pyspark.sql import functions as F

from tessera import plugins
from tessera.engine import Engine
from tessera.operators import search


class Scripted:
    """Answers by the start of the prompt."""

    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def complete(self, prompt):
        self.asked.append(prompt)
        return self.answers.get(prompt.split()[0], "nothing")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("e")), buckets=2)
    texts = {"fox": "# Fox\nThe red fox runs.", "bear": "# Bear\nThe brown bear sleeps in winter.", "owl": "# Owl\nThe owl hunts at night."}
    e.put(spark.createDataFrame([(f"/d/{k}.md", t) for k, t in texts.items()], "file_path string, markdown string").withColumn("modified", F.expr("timestamp '2024-01-01'")))
    return e


def test_queries_share_the_places(engine):
    got = engine.search_all(["bear winter", "owl", "bear"], "/d/", 6).collect()
    assert [(r.rank, r.title) for r in got] == [(1, "bear.md"), (2, "owl.md")]
    assert [r.title for r in engine.search_all(["fox"]).collect()] == ["fox.md"]


def test_answer_names_its_sources(engine):
    r = engine.answer("brown bear").first()
    assert r.documents == 1 and r.prompt.startswith("## bear.md") and r.urls == ["/d/bear.md"] and "bear.md (/d/bear.md)" in r.sources
    facts = engine.answer("brown bear", "deepSearch", "/d/").collect()
    assert [(f.url, "brown bear" in f.facts) for f in facts] == [("/d/bear.md", True)]


def test_a_model_asks_in_several_ways(engine, monkeypatch):
    model = Scripted(Write="who sleeps in winter\nwho hunts at night\n\nwho sleeps in winter")
    monkeypatch.setattr(engine, "model", model)
    hits = engine.answer("which animals", "search", "/d/").collect()
    assert {h.title for h in hits} == {"bear.md", "owl.md"}
    assert plugins.queries_with(Scripted(Write="a\nb\nc\nd\ne\nf\ng"), "q") == ["q", "a", "b", "c", "d"]

    class Down:
        def complete(self, prompt):
            raise OSError("down")

    assert plugins.queries_with(Down(), "q") == ["q"]


def test_the_handler_of_the_path_answers(spark, engine):
    class Web:
        def rewrite(self, question):
            return search.rewrite(question)

        def search(self, query):
            return spark.createDataFrame([(1, "t", "http://a", query.original)], "rank int, title string, url string, content string")

        rerank = lambda self, hits, question: hits
        content = lambda self, hits: hits
        paths = lambda self: None
        collect_facts = lambda self, question, path: spark.createDataFrame([(question, path)], "q string, p string")

    engine.registry.register("/web/", Web())
    r = engine.answer("anything", path="/web/x").first()
    assert r.urls == ["http://a"] and "anything" in r.prompt and engine.answer("q", "deepSearch", "/web/y").first().p == "/web/y"
    assert engine.answer("fox", "search", "/d/").first().title == "fox.md"


def test_an_upload_registers_its_folder(engine, tmp_path):
    (tmp_path / "in").mkdir()
    path = engine.upload(str(tmp_path / "in"), "late.md", b"late zebra")
    engine.upload(f"{tmp_path}/in/", "more.md", b"more")
    assert [r.directory_path for r in engine.directories().collect()] == [f"{tmp_path}/in"]
    summary = engine.sync().first()
    assert (summary.total, summary.failed) == (1, []) and engine.search("zebra").first().url == path
