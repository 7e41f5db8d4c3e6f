import io
import zipfile

from tessera.sources import files, parsers, web


def office(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


DOCX = office(word__document_xml='<w:document xmlns:w="w"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:document>')
XLSX = office(
    xl__sharedStrings_xml="<sst><si><t>a</t></si><si><t>b</t></si></sst>",
    xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>2</v></c></row><row><c t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>',
    xl__worksheets__sheet2_xml="<worksheet><row><c><v>9</v></c></row></worksheet>",
)
PPTX = office(ppt__slides__slide1_xml='<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>Hello</a:t></a:p></p:sld>')


class Reader:
    def recognise(self, image):
        return "seen"


def test_parsers():
    assert parsers.parse("docx", "x", DOCX) == ("One two\n\nThree", None)
    assert parsers.parse("xlsx", "x", XLSX) == ("b | 2\nz", None)
    assert parsers.parse("pptx", "x", PPTX) == ("## Slide 1\nHello", None)
    assert parsers.parse("png", "a/i.png", b"") == ("i.png", None)
    assert parsers.parse("png", "a/i.png", b"", Reader()) == ("## Image i.png\nseen", None)
    assert parsers.parse("archive", "x", b"zz") == ("", None)
    body, error = parsers.parse("docx", "x", b"not a zip")
    assert body == "" and "BadZipFile" in error
    assert parsers.fitted(1600, 400) == (800, 200) and parsers.fitted(10, 20) == (10, 20)
    assert parsers.enough("a b", 1) and not parsers.enough("a b", 2)


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "src.d" / ".git").mkdir(parents=True)
    (tmp_path / "src.d" / "a.md").write_text("# T\nbody")
    (tmp_path / "src.d" / "b.docx").write_bytes(DOCX)
    (tmp_path / "src.d" / "c.zip").write_bytes(b"x")
    (tmp_path / "src.d" / "bad.docx").write_bytes(b"x")
    (tmp_path / "src.d" / ".git" / "h.md").write_text("no")
    listed = files.listing(spark, str(tmp_path), content=True)
    kept = files.readable(files.unignored(listed, ["**/.git/"]))
    got = {r.path: r for r in files.parsed(kept).collect()}
    assert sorted(got) == ["src.d/a.md", "src.d/b.docx", "src.d/bad.docx"]
    assert got["src.d/a.md"].markdown == "# a.md\nname: a.md\nextension: md\n## content\n# T\nbody"
    assert got["src.d/b.docx"].markdown.endswith("One two\n\nThree") and got["src.d/bad.docx"].error
    assert "content" not in files.listing(spark, str(tmp_path)).columns


def test_logs_and_settings(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(f"line {i}" for i in range(1, 21)))
    lines = files.log_lines(spark, str(tmp_path / "x.log"))
    assert [r.number for r in files.log_tail(lines, 3).collect()] == [18, 19, 20]
    assert [r.line for r in files.log_tail(lines, known=19).collect()] == ["line 20"]
    settings = spark.createDataFrame([("n", "5"), ("s", '"x"'), ("l", "[1,2]"), ("bad", "zz")], "config_key string, config_value string")
    value = lambda *a: files.setting(settings, *a).first().value
    assert (value("n", "int", 1), value("s", "string", ""), value("l", "array<int>", "[]"), value("bad", "int", 7), value("none", "int", 8)) == (5, "x", [1, 2], 7, 8)


PAGE = """<div class="result"><a href="http://a/1">One <b>x</b></a><p class="description">d &amp; e</p><span class="date">2024</span></div>
<div class="result ad"><a href="http://ad">Ad</a></div><div class="result"><a href="http://a/1">again</a></div><div class="result"><a href="http://b/2">Two</a></div>"""


def test_search_source(spark):
    web.register(spark)
    rows = spark.read.format("web_search").option("pages", PAGE + "\f" + PAGE).load()
    got = web.results(rows).collect()
    assert [(r.title, r.url, r.description) for r in got] == [("One x", "http://a/1", "d & e"), ("Two", "http://b/2", "")]
    assert web.results(rows, 1).count() == 1


def test_pages_are_read_until_enough_results_count(spark):
    web.register(spark)
    more = PAGE.replace("http://b/2", "http://c/3")
    pages = [PAGE, PAGE, more, PAGE, "", PAGE]
    read = lambda n: {r.position // 1000 for r in spark.read.format("web_search").option("pages", "\f".join(pages)).option("wanted", n).load().collect()}
    assert [read(n) for n in (1, 2, 3, 4)] == [{0}, {0}, {0, 1, 2}, {0, 1, 2, 3}]  # ads and repeated urls don't count; an empty page ends it


def test_pages_are_asked_for_again(spark):
    def fetch(url):
        if url == "http://bad":
            raise OSError("down")
        return url + "/end", "<p>hi</p>"

    urls = spark.createDataFrame([("http://a",), ("http://bad",)], "url string")
    got = {r.url: r for r in web.fetched(urls, fetch, delay=0.0).collect()}
    assert (got["http://a"].final_url, got["http://a"].html, got["http://a"].error) == ("http://a/end", "<p>hi</p>", None)
    assert got["http://bad"].html == "" and "down" in got["http://bad"].error


def test_log_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\r\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.log_lines(spark, str(tmp_path / "big.log"))
        assert lines.rdd.getNumPartitions() > 2
        assert all(r.line == f"line {r.number}" for r in lines.collect()) and lines.count() == 2000
        assert [r.line for r in files.log_tail(lines, 2).collect()] == ["line 1999", "line 2000"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_wanted_files_are_opened(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k} [x].md").write_text(f"text {k}")
    listed = files.readable(files.listing(spark, str(tmp_path)))
    wanted = listed.filter("path LIKE 'f1%' OR path LIKE 'f3%'")
    for by_name in (10, 1):
        got = {r.path: bytes(r.content) for r in files.contents(spark, str(tmp_path), wanted, by_name).collect()}
        assert got == {"f1 [x].md": b"text 1", "f3 [x].md": b"text 3"}
    assert files.contents(spark, str(tmp_path), wanted.limit(0)).count() == 0
