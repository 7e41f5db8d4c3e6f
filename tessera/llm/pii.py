"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is SQL expressions in the JVM. For each kind the whole text is cut once at the pattern's
matches (split) and the matches are listed (regexp_extract_all); running sums of the lengths give code
point offsets. A kind's pattern runs only on texts that hold a character it needs. Possessive
quantifiers and a guard on the left neighbour (or the end of the previous match) keep long runs
linear without changing what matches.

Kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits) are the
base; added are iban (mod-97), ssn (a number of 3, 2 and 4 digits) and birth (a date of birth), the last
two without a checksum. Each span has a score: a prior for its kind, more for a passed checksum, STEP
more or less for words within BEFORE characters before it or AFTER behind it (up to the neighbouring
match of its kind). Base spans are always kept, an added span if its score reaches THRESHOLD: an ssn or
a birth date needs a word that speaks for it and none that speaks against it.

Defined results: a null text counts as empty and has no spans; every input row gives one row, null or
repeated doc_ids included; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: kind: (a regular expression that every text with a match fulfils, the pattern), in output order.
PATTERNS = {
    "email": (r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"),
    "card": (r"[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z][A-Z][0-9][0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])"),
    "ssn": (r"[0-9]-[0-9][0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "birth": (r"[0-9][./-][0-9]", r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9./-])"),
}
BASE = ("email", "ip", "card", "phone")
#: Prior score of a kind, and what a passed checksum adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.4, "ssn": 0.4, "birth": 0.4}
CHECKED = {"email": 0.0, "ip": 0.1, "card": 0.4, "phone": 0.0, "iban": 0.4, "ssn": 0.0, "birth": 0.0}
#: Words near a span that make it likelier or less likely, and by how much.
NEAR = {
    "email": r"mail|contact|write|courriel|correo",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": r"card|visa|master|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|anruf|appel",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|sozialversicherung|sécurité sociale|seguridad social",
    "birth": r"\bborn\b|birth|\bdob\b|\bgeb(?:oren|urt|\.)|\bnée? |naissance|\bnacid[ao]\b|nacimiento",
}
AGAINST = r"version|release|example|sample|order no|isbn|beispiel|exemple"
STEP, BEFORE, AFTER, THRESHOLD = 0.15, 40, 20, 0.5
#: Lengths are summed in runs of this many matches, so that a text of many matches stays near-linear.
RUN = 256


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(lengths: str) -> str:
    """Sums of the elements before each element of an int array, in two levels."""
    before = "aggregate({x}, named_struct('t', {first}, 'a', cast(array() as array<int>)), (s, v) -> named_struct('t', s.t + v, 'a', array_append(s.a, s.t)), s -> s.a)"
    runs = f"transform(sequence(0, greatest(cast(ceil(size({lengths}) / {RUN}) as int) - 1, 0)), r -> slice({lengths}, r * {RUN} + 1, {RUN}))"
    totals = f"transform({runs}, r -> aggregate(r, 0, (s, v) -> s + v))"
    starts = before.format(x=totals, first="0")
    inner = before.format(x="r", first="b")
    return f"flatten(zip_with({runs}, {starts}, (r, b) -> {inner}))"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = _digits(x)
    step = f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + int(substring({d}, length({d}) + 1 - i, 1)) * (1 + (i + 1) % 2) - IF(i % 2 = 0 AND int(substring({d}, length({d}) + 1 - i, 1)) > 4, 9, 0))"
    return f"(length({d}) BETWEEN 16 AND 19 AND {step} % 10 = 0)"


def _mod97(x: str) -> str:
    bare = f"replace({x}, ' ', '')"
    turned = f"concat(substring({bare}, 5), substring({bare}, 1, 4))"
    value = "IF(c BETWEEN '0' AND '9', int(c), ascii(c) - 55)"
    fold = f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (s, c) -> (s * IF(c BETWEEN '0' AND '9', 10, 100) + {value}) % 97)"
    return f"(length({bare}) BETWEEN 15 AND 34 AND {fold} = 1)"


VALID = {
    "email": lambda x: "true",
    "ip": lambda x: f"({x} RLIKE '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})([.]0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})){{3}}$')",
    "card": _luhn,
    "phone": lambda x: f"(length({_digits(x)}) BETWEEN 8 AND 15)",
    "iban": _mod97,
    "ssn": lambda x: f"(NOT {x} RLIKE '^(000|666|9)|-00-|-0000$')",
    "birth": lambda x: f"({x} RLIKE '^((0?[1-9]|[12][0-9]|3[01])[./-](0?[1-9]|1[0-2])[./-]|(0?[1-9]|1[0-2])[./-](0?[1-9]|[12][0-9]|3[01])[./-])?(19|20)[0-9]{{2}}(-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01]))?$')",
}
SPAN = "array<struct<kind:string,start:int,stop:int,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and for each kind an array of (kind, start, stop, score), by start."""
    out = docs.select(docs[id_col].alias("doc_id"), common.text_of(docs, text_col).alias("t"))
    for kind, (need, pattern) in PATTERNS.items():
        hit = f"t RLIKE {_quote(need)}"
        out = out.withColumn("m", F.expr(f"IF({hit}, regexp_extract_all(t, {_quote(pattern)}, 0), cast(array() as array<string>))"))
        # one part more than matches: the text before each match and behind the last
        out = out.withColumn("s", F.expr(f"IF(size(m) > 0, slice(split(t, {_quote(pattern)}, -1), 1, size(m) + 1), cast(array() as array<string>))"))
        out = out.withColumn("g", F.expr("transform(slice(s, 1, size(m)), x -> length(x))"))
        out = out.withColumn("n", F.expr("zip_with(g, m, (a, b) -> a + length(b))"))
        out = out.withColumn("b", F.expr(f"IF(size(m) > 0, {_running('n')}, cast(array() as array<int>))"))
        out = out.withColumn("p", F.expr(f"transform(slice(s, 1, size(m)), x -> right(x, {BEFORE}))"))
        out = out.withColumn("q", F.expr(f"transform(slice(s, 2, size(m)), x -> left(x, {AFTER}))"))
        near = "lower(concat(x.p, ' # ', x.q))"
        score = (
            f"{PRIOR[kind] + CHECKED[kind]}D + IF({near} RLIKE {_quote(NEAR[kind])}, {STEP}D, 0D) - IF({near} RLIKE {_quote(AGAINST)}, {STEP}D, 0D)"
        )
        span = f"named_struct('kind', '{kind}', 'start', x.b + x.g, 'stop', x.b + x.g + length(x.m), 'score', round(least(1D, greatest(0D, {score})), 2))"
        found = f"transform(filter(arrays_zip(b, g, m, p, q), x -> {VALID[kind]('x.m')}), x -> {span})"
        if kind not in BASE:
            found = f"filter({found}, x -> x.score >= {THRESHOLD}D)"
        out = out.withColumn(kind, F.expr(f"IF(size(m) > 0, {found}, cast(array() as {SPAN}))"))
    return out.select("doc_id", *PATTERNS)


def digest(found: DataFrame) -> DataFrame:
    text = lambda kinds: "array_join(transform(concat({}), x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')".format(", ".join(kinds))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(text(BASE)).cast("binary"), 256).alias("base_sha256"),
        F.expr(text(PATTERNS)).alias("spans"),
        F.expr(f"array_join(transform(concat({', '.join(PATTERNS)}), x -> x.score), ',')").alias("scores"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(common.read_table(spark, sf_dir, "documents")))
