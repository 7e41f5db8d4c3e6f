import json

from tessera.streaming import catalog_stream, events


def test_windows_of_stream_and_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    got = events.replay(spark, str(tmp_path / "in"), batch.schema, "windows_test", str(tmp_path / "cp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, events.windowed(batch).collect()))


def test_catalog_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()

    def put(name, *rows):
        keys = ("seq", "op", "doc_id", "file_path", "md5", "modified", "text")
        (source / name).write_text("\n".join(json.dumps(dict(zip(keys, r))) for r in rows))

    stream = catalog_stream.CatalogStream(spark, str(tmp_path / "c"), ["*.tmp"])
    put("1.json", (1, "create", 1, "/a.md", "m", "2024-01-01 00:00:00", "red fox"), (2, "create", 2, "/b.tmp", "m", "2024-01-01 00:00:00", "x"))
    stream.start(catalog_stream.file_events(spark, str(source))).awaitTermination()
    put("2.json", (3, "modify", 1, "/a.md", "n", "2024-01-02 00:00:00", "blue"), (4, "create", 3, "/c.md", "k", "2024-01-02 00:00:00", "y"), (5, "delete", 3, "/c.md", None, None, None))
    stream.start(catalog_stream.file_events(spark, str(source))).awaitTermination()
    assert {(r.file_path, r.md5, r.state) for r in stream.read().collect()} == {("/a.md", "n", "file_indexed"), ("/b.tmp", "m", "ignored")}
    assert {r.term for r in stream.postings().collect()} == {"blue"}
    assert [r.doc_id for r in stream.index.bm25(["blue"]).collect()] == [1] and stream.index.sized().first().n == 1
    stream._batch(spark.read.schema(catalog_stream.EVENT).json(str(source / "2.json")), 1)  # replayed
    assert stream.read().count() == 2 and [r.doc_id for r in stream.index.bm25(["blue"]).collect()] == [1]
