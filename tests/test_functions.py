import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import globs, text

PATTERNS = ["**/.idea/", "**/target/", "**/*.avi", "*.log", "app.log.*", "app.log.[0-9]*", "app.log.20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]*"]
HIT = """.idea project/.idea deep/nested/project/.idea .idea/workspace.xml /user/login/project/.idea/workspace.xml target module/target
deep/nested/project/target target/classes/com/example/Main.class video.avi videos/movie.avi path/to/deep/nested/file.avi server.log app.log app.log.1
app.log.2023-12-31 app.log.2024-01-09 app.log.backup app.log.2024-01-09.1 app.log.2024-01-09.gz""".split()
MISS = "my.idea folder.idea/file mytarget targetfolder/file avi.txt video.avi.mp4 fake.avii myapp.log.2024 test.log.txt app.login log/app.txt".split()


def test_globs(spark):
    rows = spark.createDataFrame([(p,) for p in HIT + MISS], "path string").select("path", globs.ignored(F.col("path"), PATTERNS).alias("hit"))
    assert {r.path: r.hit for r in rows.collect()} == {p: True for p in HIT} | {p: False for p in MISS}
    assert spark.range(1).filter(globs.ignored(F.lit("a/b"), [])).count() == 0


def test_glob_validation():
    assert globs.validate([" *.log ", "", "*.log", "\u4e2d", "a;b"]) == (["*.log"], ["\u4e2d", "a;b"])


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        (lambda: text.extension(F.lit("a/b.c/d")), "c/d"),
        (lambda: text.parent_path(F.lit("/a/b")), "/a"),
        (lambda: text.parent_path(F.lit("/a")), "/a"),
        (lambda: text.parent_path(F.lit("C:\\x\\y")), "C:\\x"),
        (lambda: text.normal_prefix(F.lit("/local/D:\\w\\\\p")), "D:/w/p"),
        (lambda: text.normal_prefix(F.lit("/localx/a")), "/localx/a"),
        (lambda: text.title(F.lit("\nfirst\n# Head\n")), "Head"),
        (lambda: text.title(F.lit("\n first\nx")), "first"),
        (lambda: text.clean_query(F.lit(None).cast("string")), ""),
        (lambda: text.clean_query(F.lit("a,b.c")), "a b c"),
        (lambda: text.reference_text(F.lit("## <h2>T</h2>\na<br/>b")), "T a b"),
        (lambda: text.json_candidate(F.lit('x ```json\n{"a": 1}\n``` y')), '{"a": 1}'),
        (lambda: text.json_candidate(F.lit(' [1, {"a": {}}] ')), '[1, {"a": {}}]'),
        (lambda: text.json_candidate(F.lit('so {"a": {"b": 1}} then')), '{"a": {"b": 1}}'),
        (lambda: text.json_candidate(F.lit("none")), None),
        (lambda: text.json_candidate(F.lit('Use {"a":1} or {"b":2} here')), '{"a":1}'),
        (lambda: text.json_candidate(F.lit('see [1] {"answer":[]} ok')), "[1]"),
        (lambda: text.json_candidate(F.lit('x [a] {"s": "]} \\" {"} y')), '{"s": "]} \\" {"}'),
        (lambda: text.json_candidate(F.lit('{ open "never\n[1, {"a": [2]}] }')), '[1, {"a": [2]}]'),
        (lambda: text.json_candidate(F.lit('```json\n{"a": 1} trailing\n``` [2]')), '{"a": 1}'),
        (lambda: text.json_candidate(F.lit("```json\n42\n``` [2]")), "42"),
        (lambda: text.json_candidate(F.lit("```json\n42 x\n``` [2]")), "[2]"),
        (lambda: text.json_candidate(F.lit('{"a": 1')), None),
        (lambda: text.json_candidate(F.lit(None).cast("string")), None),
        (lambda: text.valid_text(F.lit(" a b\n"), 1), True),
        (lambda: text.valid_text(F.lit(None).cast("string"), 0), False),
    ],
)
def test_columns(spark, sql, want):
    assert spark.range(1).select(sql()).first()[0] == want


def test_patterns_are_judged_alike(spark):
    patterns = ["build", "*.tmp", "a|b", "-x", "src/**", "?", "[a]", "a b", "é", "./x", "a\nb", "_a", "!a"]
    rows = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", globs.valid(F.col("p")).alias("v")).collect()
    good, _ = globs.validate(patterns)
    assert {r.p for r in rows if r.v} == set(good)


def test_like_pattern(spark):
    rows = spark.createDataFrame([("/a_b/c",), ("/axb/c",)], "p string")
    assert [r.p for r in rows.filter(F.col("p").like(text.like_pattern("/a_*"))).collect()] == ["/a_b/c"]


def test_facts_of_answers(spark):
    answer = 'Sure:\n```json\n{"answer": [{"fact": "f", "id": "7", "more": 1}, {"fact": " ", "id": "8"}, {"fact": "g", "id": "x"}]}\n```'
    got = spark.createDataFrame([(answer,), ("no json",), (None,)], "r string").select(text.parsed_facts(F.col("r")).alias("x")).collect()
    assert [[(y.fact, y.id) for y in r.x] for r in got] == [[("f", 7), ("g", None)], [], []]


def test_json_values_equal_a_decoder_at_every_place(spark):
    """Prose with stray brackets; quotes stand in values only."""
    r = random.Random(6)
    value = lambda n: r.choice([r.randint(0, 9), "a]}", 'q"[{\\', None, [], {}] + ([[value(n - 1) for _ in range(2)], {"k[": value(n - 1), "é": 1.5}] if n else []))
    texts = []
    for _ in range(400):
        texts.append(r.choice(["", " ", "\n"]).join(r.choice(["say", "🙂", "[", "]", "{", "}", "x: y,", json.dumps([value(2)]), json.dumps({"z": value(2)}, ensure_ascii=False)]) for _ in range(r.randint(0, 7))))

    def decoded(t):
        out, k = [], 0
        while k < len(t):
            if t[k] in "[{":
                try:
                    end = json.JSONDecoder().raw_decode(t, k)[1]
                except ValueError:
                    end = None
                if end:
                    out.append(t[k:end])
                    k = end
                    continue
            k += 1
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.json_values(F.col("t")).alias("v")).collect()
    for row in rows:
        assert row.v == decoded(texts[row.k]), texts[row.k]


def test_facts_of_the_value_that_has_some(spark):
    answers = ['[1] says {"answer": [{"fact": "f", "id": 3}]} and {"answer": [{"fact": "g", "id": 4}]}', '```json\n{"answer": []}\n``` [{"fact": "h", "id": "5"}]', '{"answer": 7} {"other": []}']
    got = spark.createDataFrame([(a,) for a in answers], "r string").select(text.parsed_facts(F.col("r")).alias("x")).collect()
    assert [[(y.fact, y.id) for y in r.x] for r in got] == [[("f", 3)], [("h", 5)], []]


def test_dice_counts_repeats(spark):
    got = spark.range(1).select(*(text.dice(F.lit(a), F.lit(b)) for a, b in (("aaaa", "aa"), ("night", "nacht"), ("", "x")))).first()
    assert list(got) == [0.5, 0.25, 0.0]


def test_best_fragment(spark):
    t = "x" * 300 + "key " * 3 + "y" * 400
    got = spark.range(1).select(text.best_fragment(F.lit(t), "key").alias("f")).first().f
    assert got.hits == 3 and got.fragment.startswith("key key")
