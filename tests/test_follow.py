"""Document states by timers, and logs as streams: what was done before a restart isn't done again."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.engine import Engine
from tessera.sources import logs
from tessera.streaming import documents

COLUMNS = [c.split()[0] for c in documents.EVENT.split(", ")]


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", documents.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


class Flaky:
    """Fails on a path until a file named after it is there; notes its calls."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, path, content):
        name = path.rpartition("/")[2]
        with open(f"{self.folder}/log-{name}", "a") as log:
            log.write("x")
        if "bad" in name and not os.path.exists(f"{self.folder}/ok-{name}"):
            raise ValueError("not yet")
        return content.decode()

    def calls(self, name):
        at = f"{self.folder}/log-{name}"
        return os.path.getsize(at) if os.path.exists(at) else 0


def put(spark, at, name, rows):
    made = [(i, seq, op, path, body and bytearray(body.encode())) for i, seq, op, path, body in rows]
    frame = spark.createDataFrame(made, "doc_id long, seq long, op string, file_path string, content binary").withColumn("modified", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    frame.select(COLUMNS).coalesce(1).write.mode("append").parquet(f"{at}/{name}")


def until(done, seconds=240):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.3)


def test_retries_go_on_after_a_restart(spark, tmp_path):
    events, work = tmp_path / "events", tmp_path / "work"
    events.mkdir()
    work.mkdir()
    handler, engine = Flaky(work), Engine(spark, str(tmp_path / "e"), buckets=2)
    stream = lambda: spark.readStream.schema(documents.EVENT).option("recursiveFileLookup", True).parquet(str(events))
    start = lambda: engine.follow(stream(), handler, attempts=30, delay=0.5, period="300 milliseconds")
    put(spark, events, "a", [(1, 1, "save", "/d/one.md", "red fox"), (2, 2, "save", "/d/bad.md", "brown bear"), (3, 3, "save", "/d/gone.md", "x"), (3, 4, "delete", "/d/gone.md", None)])
    states = lambda: {r.file_path: r.state for r in engine.documents().collect()}
    query = start()
    until(lambda: query.lastProgress and query.lastProgress["batchId"] >= 1 and handler.calls("bad.md") >= 2)
    query.stop()
    assert states() == {"/d/one.md": schemas.INDEXED} and handler.calls("gone.md") == 0  # its last event decides
    before = handler.calls("bad.md")
    (work / "ok-bad.md").write_text("")
    query = start()
    until(lambda: states() == {"/d/one.md": schemas.INDEXED, "/d/bad.md": schemas.INDEXED})
    assert handler.calls("one.md") == 1 and before < handler.calls("bad.md") <= before + 2  # the batch that was cut short may run again
    assert engine.search("bears").first().url == "/d/bad.md"
    put(spark, events, "b", [(1, 9, "delete", "/d/one.md", None)])
    until(lambda: set(states()) == {"/d/bad.md"})
    query.stop()


def test_a_document_fails_by_itself(spark, tmp_path):
    events, work = tmp_path / "events", tmp_path / "work"
    events.mkdir()
    work.mkdir()
    handler, engine = Flaky(work), Engine(spark, str(tmp_path / "e"), buckets=2)
    put(spark, events, "a", [(1, 1, "save", "/d/one.md", "red fox"), (2, 2, "save", "/d/bad.md", "brown bear")])
    query = engine.follow(spark.readStream.schema(documents.EVENT).option("recursiveFileLookup", True).parquet(str(events)), handler, 2, 0.2, "200 milliseconds")
    until(lambda: {r.file_path: r.state for r in engine.documents().collect()} == {"/d/one.md": schemas.INDEXED, "/d/bad.md": schemas.ERROR})
    query.stop()
    assert handler.calls("bad.md") == 2 and engine.search("bear").count() == 0


def test_parsing_by_format():
    assert documents.parsing("/a/b.TXT", "é".encode()) == "é"
    with pytest.raises(ValueError):
        documents.parsing("/a/b.docx", b"no zip")
    with pytest.raises(UnicodeDecodeError):
        documents.parsing("/a/b.md", b"\xff")


# -- logs -------------------------------------------------------------------------------------


def test_lines_after_a_restart_come_once(spark, tmp_path):
    log, out = tmp_path / "x.log", str(tmp_path / "out")
    logs.register(spark)

    def run():
        lines = spark.readStream.format("log_lines").option("path", str(log)).load()
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return [r.line for r in spark.read.parquet(out).orderBy("at").collect()]

    log.write_bytes(b"one\r\ntwo\n\nhal")
    assert run() == ["one", "two", ""]
    assert run() == ["one", "two", ""]
    with log.open("ab") as f:
        f.write("f é\nthree\n".encode())
    assert run() == ["one", "two", "", "half é", "three"]


def test_ranges_give_each_line_once(tmp_path, monkeypatch):
    import random

    r = random.Random(3)
    log = tmp_path / "x.log"
    want = ["".join(r.choice("ab é") for _ in range(r.randint(0, 30))) for _ in range(200)]
    log.write_text("\n".join(want) + "\nunfinished", encoding="utf-8")
    for size in (1, 3, 7, 50, 10_000):
        monkeypatch.setattr(logs, "RANGE", size)
        monkeypatch.setattr(logs, "LOOK", max(2, size // 2))
        reader = logs.LogReader({"path": str(log)})
        spans = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [x for s in spans for x in reader.read(s)]
        assert [line for _, line in got] == want and [at for at, _ in got] == sorted(at for at, _ in got)
    new = logs.LogReader({"path": str(log), "begin": "end"})
    assert new.initialOffset() == new.latestOffset()
    log.write_text("anew\n")
    assert [x for s in new.partitions({"at": 4000}, new.latestOffset()) for x in new.read(s)] == [(0, "anew")]
    assert logs.LogReader({"path": str(tmp_path / "none")}).latestOffset() == {"at": 0}
