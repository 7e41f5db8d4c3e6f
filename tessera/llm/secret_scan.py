"""Secret scans: wide candidate patterns, and a random forest that removes false positives.

Every key-like run of a text (MIN_LENGTH or more of letters, digits and + / _ -, with digits or
without) is a candidate. Features: its length, its character transitions (the mean log ratio, in
secrets against look-alikes, of the pairs of neighbouring characters, learned from the labelled
findings, beside counts of class changes), the share of it that dictionary words cover (the corpus's
DICTIONARY most frequent words, counted over all its texts, and WORDS), the document's path and the
words before and after. A random forest trained on labelled findings gives each candidate the
probability of being a secret; those at THRESHOLD or more are findings. Everything is DataFrame and
SQL expressions; the forest is the engine's own.

Labelled findings are a table (value, before, after, path, label); without one, labelled_findings()
makes LABELLED examples of secrets and look-alikes from a seed.

Defined results: a null text counts as empty and has no candidates; every input row gives one row, null
and repeated doc_ids included; a null path counts as empty; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pii

MIN_LENGTH, THRESHOLD, LABELLED = 16, 0.5, 6_000
#: Words of a corpus that count as its dictionary.
DICTIONARY = 1_000
TREES, DEPTH, SEED = 24, 7, 13
BEFORE, AFTER = 40, 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+"
#: Words whose letters count as covered by a dictionary.
WORDS = (
    "about account address admin after again also answer api back base before between build button cache change class client code "
    "color com config content count country create data date default delete demo design detail dev document domain download edit "
    "email error event example field file first form format from function get group header height help home host html http image "
    "index info input issue item key lang language last level library line link list local login main manager map menu message "
    "method mode model module name net new news node note number object old open option order org other output page part password "
    "path photo place plan point post print product profile project public query read release report request response result right "
    "road root sample save scale screen script search secret section select server service session set show site size source start "
    "state static status step store string style super support system table tag target task template test text that the this time "
    "title token tool type update upload url user value version video view web week width window with word work world www year"
).split()
#: Characters of a run as transitions see them: small letters, and one each for capitals, digits and marks.
ALPHABET = "abcdefghijklmnopqrstuvwxyzA0-"
SHAPE = f"translate(value, 'BCDEFGHIJKLMNOPQRSTUVWXYZ123456789+/_', '{'A' * 25}{'0' * 9}---')"
KEYWORDS = r"key|secret|token|passw|pwd|credential|auth|bearer|private|access"
BENIGN = r"sha-?[0-9]|md5|checksum|digest|commit|revision|uuid|guid|version|isbn|example|sample|dummy|placeholder|card|phone"
TEST_PATH = r"test|spec|example|sample|mock|fixture|demo|doc"
CONFIG_PATH = r"conf|env|secret|credential|deploy|settings"
ASSIGNED = r"[=:]\s*[\"']?$"
KNOWN = r"^(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_live_|AIza|eyJ)"

_LOW = "lower(value)"
FEATURES = {
    "length": "double(length(value))",
    "transitions": "regexp_count(value, '(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]') / length(value)",
    "digits": "regexp_count(value, '[0-9]') / length(value)",
    "uppers": "regexp_count(value, '[A-Z]') / length(value)",
    "hex": "regexp_count(value, '[0-9a-f]') / length(value)",
    "marks": "regexp_count(value, '[+/_-]') / length(value)",
    "distinct": "size(array_distinct(split(value, ''))) / length(value)",
    "run": "double(length(regexp_extract(value, '([A-Za-z]{1,64})', 1)))",
    "known": f"double(value RLIKE '{KNOWN}')",
    "keyword": f"double(lower(before) RLIKE '({KEYWORDS})[^a-z]*$')",
    "assigned": f"double(before RLIKE {pii._quote(ASSIGNED)})",
    "benign": f"double(lower(concat(before, ' ', after)) RLIKE '{BENIGN}')",
    "address": "double(before RLIKE '[@.]$' OR after RLIKE '^[@.][A-Za-z0-9]')",
    "test_path": f"double(lower(path) RLIKE '{TEST_PATH}')",
    "config_path": f"double(lower(path) RLIKE '{CONFIG_PATH}')",
}


class Model(NamedTuple):
    forest: RandomForestClassificationModel
    #: Log ratios of pairs of ALPHABET, row by row.
    transitions: list[float]
    words: list[str]

    def features(self) -> dict[str, str]:
        return features(self.transitions, self.words)


def features(transitions: list[float], words: list[str]) -> dict[str, str]:
    n = len(ALPHABET)
    place = lambda i: f"instr('{ALPHABET}', substring(shape, {i}, 1))"
    ratio = f"element_at(array({', '.join(f'{x}D' for x in transitions)}), ({place('i')} - 1) * {n} + {place('i + 1')})"
    known = longest_of({w for w in words if len(w) > 2})
    return FEATURES | {
        "pairs": f"IF(length(shape) > 1, aggregate(sequence(1, length(shape) - 1), 0D, (s, i) -> s + {ratio}) / (length(shape) - 1), 0D)",
        "covered": f"1 - length(regexp_replace({_LOW}, '{known}', '')) / length(value)" if known else "0D",
    }


def longest_of(words: set[str]) -> str:
    """A pattern for the longest of some words of letters at a place: alternatives part at their first different letter, so a letter rules out all words but those that go on with it."""
    out = []
    for first in sorted({w[0] for w in words if w}):
        rest = {w[1:] for w in words if w.startswith(first)}
        more = longest_of(rest - {""})
        out.append(first + (f"(?:{more})?" if more and "" in rest else f"(?:{more})" if more else ""))
    return "|".join(out)


def learned_transitions(labelled: DataFrame) -> list[float]:
    """Log ratios of each pair's share in secrets and in look-alikes, each pair counted once more."""
    pairs = labelled.filter("length(value) > 1").select("label", F.explode(F.expr(f"transform(sequence(1, length(value) - 1), i -> substring({SHAPE}, i, 2))")).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("of"), F.count(F.lit(1)).alias("all"))
    got = {r["pair"]: (r["of"], r["all"] - r["of"]) for r in counts.filter(F.col("pair").rlike("^[a-zA0-]{2}$")).collect()}
    size = len(ALPHABET) ** 2
    secret, other = (sum(x[k] for x in got.values()) + size for k in (0, 1))
    ratio = lambda x: math.log((x[0] + 1) / secret) - math.log((x[1] + 1) / other)
    return [round(ratio(got.get(a + b, (0, 0))), 6) for a in ALPHABET for b in ALPHABET]


def dictionary(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY) -> list[str]:
    """The n most frequent words of 4 to 12 letters a-z, over all texts; of equal counts the first by name."""
    words = F.filter(F.split(F.lower(common.text_of(docs, text_col)), "[^a-z]+"), lambda w: F.length(w).between(4, 12))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(n).collect()]


def candidates(docs: DataFrame, text_col: str = "text", path_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, start, stop, value, before, after, path) of each candidate; one row with null value if none."""
    p = pii._quote(CANDIDATE)
    path = docs[path_col].cast("string") if path_col in docs.columns else F.lit("")
    out = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("doc_id"), common.text_of(docs, text_col).alias("t"), F.coalesce(path, F.lit("")).alias("path"))
    out = out.withColumn("m", F.expr(f"regexp_extract_all(t, {p}, 0)"))
    out = out.withColumn("g", F.expr(f"IF(size(m) > 0, transform(slice(split(t, {p}, -1), 1, size(m)), x -> length(x)), cast(array() as array<int>))"))
    out = out.withColumn("n", F.expr("zip_with(g, m, (a, b) -> a + length(b))"))
    out = out.withColumn("b", F.expr(f"IF(size(m) > 0, {pii._running('n')}, cast(array() as array<int>))"))
    at = "x.b + x.g"
    found = (
        f"transform(arrays_zip(b, g, m), x -> named_struct('start', {at}, 'stop', {at} + length(x.m), 'value', x.m, "
        f"'before', substring(t, greatest({at} + 1 - {BEFORE}, 1), least({at}, {BEFORE})), 'after', substring(t, {at} + length(x.m) + 1, {AFTER})))"
    )
    return out.select("row", "doc_id", "path", F.explode_outer(F.expr(found)).alias("c")).select("row", "doc_id", "path", "c.*")


def with_features(found: DataFrame, exprs: dict[str, str]) -> DataFrame:
    safe = found.withColumns({c: F.coalesce(F.col(c), F.lit("-" if c == "value" else "")) for c in ("value", "before", "after", "path")})
    rows = safe.withColumn("shape", F.expr(SHAPE)).withColumns({f"f_{k}": F.expr(f"cast({v} AS double)") for k, v in exprs.items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in exprs], outputCol="features").transform(rows)


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """n labelled examples: secrets (label 1) and look-alikes (label 0) of equal numbers, from a seed."""
    r = "sha2(concat('finding', id), 256)"
    wide = f"translate(base64(unhex(concat({r}, sha2(concat('more', id), 256)))), '=', '')"
    alnum = f"regexp_replace({wide}, '[^A-Za-z0-9]', '')"
    letters = f"regexp_replace({wide}, '[^A-Za-z]', '')"
    word = lambda k: f"element_at(array({', '.join(repr(w) for w in WORDS)}), 1 + int(pmod(xxhash64(id, {k}), {len(WORDS)})))"
    pick = lambda k, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), 1 + int(pmod(xxhash64(id, {k}), {len(xs)})))"
    prose = f"concat({word(11)}, ' ', {word(12)}, ' ')"
    named = f"concat({prose}, {pick(3, 'token', 'api_key', 'secret', 'password', 'auth_token', 'access_key')}, {pick(4, '=', ' = ', ': ')}, {pick(5, chr(34), '')})"
    neutral = f"concat({prose}, {pick(6, '', 'see ', '(', 'commit ', 'sha256: ', 'md5 ', 'version ', 'uuid ', 'file ')})"
    kinds = [
        (1, f"concat('AKIA', upper(substring({alnum}, 1, 16)))", f"IF(id % 5 = 0, {named}, {prose})"),
        (1, f"substring({r}, 1, 40)", named),
        (1, f"substring({r}, 1, 18 + int(pmod(xxhash64(id), 15)))", named),
        (1, f"substring({alnum}, 1, 20 + int(pmod(xxhash64(id), 25)))", named),
        (1, f"concat({pick(7, 'ghp_', 'sk_live_', 'AIza', 'xoxb-')}, substring({alnum}, 1, 30))", f"IF(id % 3 = 0, {named}, {prose})"),
        (0, f"concat(substring({r}, 1, 8), '-', substring({r}, 9, 4), '-', substring({r}, 13, 4), '-', substring({r}, 17, 12))", neutral),
        (0, f"substring({r}, 1, {pick(8, '32', '40', '64')})", f"concat({prose}, {pick(9, 'commit ', 'sha256: ', 'md5 ', 'checksum ', 'digest ')})"),
        (0, f"concat({word(1)}, '/', {word(2)}, '/', {word(3)}, '-', substring(cast(pmod(xxhash64(id), 9000) + 1000 as string), 1, 4))", neutral),
        (0, f"lpad(cast(pmod(xxhash64(id), 9999999999999999) as string), 16, '4')", f"concat({prose}, {pick(10, '', 'card ', 'order ', 'no ')})"),
        (0, f"concat({word(4)}, {word(5)}, {word(6)}, cast(pmod(xxhash64(id), 100) as string))", f"IF(id % 4 = 0, {named}, {neutral})"),
        (0, f"concat('AKIA', {pick(13, 'IOSFODNN7EXAMPLE', '0000000000000000', 'XXXXXXXXXXXX1234')})", f"IF(id % 2 = 0, {named}, {prose})"),
        (0, f"concat({word(7)}, '_', {word(8)}, '_', cast(pmod(xxhash64(id), 90) + 10 as string))", named),
        (0, f"substring({r}, 1, {pick(8, '32', '40', '64')})", f"concat({prose}, {pick(9, 'sha256: ', 'md5: ', 'checksum=', 'digest: ', 'commit = ', 'sha-1: ')})"),
        # without digits
        (1, f"concat('AKIA', upper(substring({letters}, 1, 16)))", f"IF(id % 5 = 0, {named}, {prose})"),
        (1, f"concat({pick(7, 'ghp_', 'sk_live_', 'AIza', 'xoxb-')}, substring({letters}, 1, 30))", f"IF(id % 3 = 0, {named}, {prose})"),
        (1, f"substring({letters}, 1, 16 + int(pmod(xxhash64(id), 25)))", named),
        (1, f"lower(substring({letters}, 1, 16 + int(pmod(xxhash64(id), 15))))", named),
        (0, f"IF(id % 3 = 0, initcap(substring({letters}, 1, 16 + int(pmod(xxhash64(id), 9)))), lower(substring({letters}, 1, 16 + int(pmod(xxhash64(id), 9)))))", neutral),
        (0, f"concat({word(16)}, {word(17)}, {word(18)}, {word(19)})", f"IF(id % 4 = 0, {named}, {neutral})"),
        (0, f"concat({word(20)}, initcap({word(21)}), initcap({word(22)}), initcap({word(23)}))", f"IF(id % 3 = 0, {named}, {neutral})"),
        (0, f"concat({word(24)}, {pick(25, '/', '_', '-')}, {word(26)}, {pick(27, '/', '_', '-')}, {word(28)}, '-', {word(29)})", f"IF(id % 3 = 0, {named}, {neutral})"),
    ]
    ones, zeros = [k for k in kinds if k[0]], [k for k in kinds if not k[0]]
    choose = lambda field: "CASE " + " ".join(
        f"WHEN id % 2 = {x} AND int(id / 2) % {len(own)} = {i} THEN {k[field]}" for x, own in ((1, ones), (0, zeros)) for i, k in enumerate(own)
    ) + " END"
    base = spark.range(0, n, 1, 2)
    return base.select(
        F.expr(choose(1)).alias("value"), F.expr(choose(2)).alias("before"),
        F.expr(pick(14, '"', " ", ".", "@mail.example.com", " and ", "\n")).alias("after"),
        # look-alikes more often lie in tests and examples, secrets in settings
        F.expr(
            f"concat(CASE WHEN pmod(xxhash64(id, 30), 10) < 5 THEN {pick(15, 'src', 'test', 'docs', 'examples', 'lib', 'config')} "
            f"WHEN id % 2 = 1 THEN {pick(31, 'src', 'config', 'deploy', '.env')} ELSE {pick(32, 'test', 'examples', 'docs', 'src')} END, '/', {word(9)})"
        ).alias("path"),
        F.expr("double(id % 2)").alias("label"),
    ).filter(f"length(value) >= {MIN_LENGTH - 1}")


def train(labelled: DataFrame, words: list[str] | None = None) -> Model:
    """A forest on labelled findings (value, before, after, path, label); words are the corpus's dictionary."""
    transitions, words = learned_transitions(labelled), sorted({*WORDS, *(words or [])})
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", minInstancesPerNode=4)
    return Model(forest.fit(with_features(labelled, features(transitions, words)).select("features", "label")), transitions, words)


def judged(found: DataFrame, model: Model) -> DataFrame:
    """found with the probability of being a secret."""
    out = model.forest.transform(with_features(found, model.features()))
    return out.withColumn("score", F.when(F.col("start").isNotNull(), F.round(vector_to_array("probability")[1], 6)))


def secret_scan(docs: DataFrame, model: Model | None = None, path_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_candidates, n_findings, findings (start:stop joined by commas), max_score."""
    model = model or train(labelled_findings(docs.sparkSession), dictionary(docs))
    each = judged(candidates(docs, path_col=path_col), model).select("row", "doc_id", "start", "stop", "score")
    hit = F.col("score") >= THRESHOLD
    spans = F.array_sort(F.collect_list(F.when(hit, F.struct("start", "stop"))))
    return (
        each.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.count("start").alias("n_candidates"), F.count(F.when(hit, 1)).alias("n_findings"), spans.alias("s"), F.max("score").alias("max_score"))
        .select("doc_id", "n_candidates", "n_findings", F.expr("array_join(transform(s, x -> concat(x.start, ':', x.stop)), ',')").alias("findings"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"))
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(common.read_table(spark, sf_dir, "documents"))
