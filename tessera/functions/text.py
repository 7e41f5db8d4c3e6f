"""Text, path and JSON functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term: a run of lower-case Latin letters and digits. RE2 and Java read it alike.
TOKEN = "[a-z0-9à-ÿœ]+"


def tokens(text: Column) -> Column:
    """Terms of a text in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def clean_query(text: Column) -> Column:
    """Commas and full stops become blanks; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[,\.]+", " "))


def extension(path: Column) -> Column:
    """What follows the last full stop of the path, else empty."""
    return F.regexp_extract(path, r"\.([^.]*)$", 1)


def parent_path(path: Column) -> Column:
    """Up to the last of / \\ or :, unless that is at the start; else the path."""
    cut = F.regexp_extract(path, r"^(.+)[/\\:][^/\\:]*$", 1)
    return F.when(cut == "", path).otherwise(cut)


def normal_prefix(path: Column) -> Column:
    """A client path for the catalog: no /local in front, no slash before a drive, one kind of slash."""
    bare = F.regexp_replace(path, r"^/local(?=/|$)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^/([A-Za-z]:)", "$1"), r"\\", "/"), r"//+", "/")


def like_pattern(wildcard: str) -> str:
    """A LIKE pattern from a path with * wildcards; the path's own % and _ are literal."""
    return wildcard.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def valid_text(text: Column, least: int) -> Column:
    """More than `least` characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) > least


def title(content: Column) -> Column:
    """The first level-one heading, else the first line that isn't blank."""
    heading = F.trim(F.regexp_extract(content, r"(?m)^#[ \t]*([^#\s][^\n]*)$", 1))
    line = F.trim(F.regexp_extract(content, r"(?m)^[ \t]*(\S[^\n]*)$", 1))
    return F.when(heading != "", heading).otherwise(line)


def envelope(name: Column, ext: Column, content: Column) -> Column:
    """A parsed file as Markdown: its name, extension and content in sections."""
    return F.concat_ws("\n", F.concat(F.lit("# "), name), F.concat(F.lit("name: "), name), F.concat(F.lit("extension: "), ext), F.lit("## content"), content)


def reference_text(text: Column) -> Column:
    """Reference text on one line: no heading tags, breaks or leading hashes."""
    bare = F.regexp_replace(text, r"</?h[1-6]>", "")
    bare = F.regexp_replace(bare, r"\n|<br\s*/?>", " ")
    return F.regexp_replace(bare, r"^#+\s*", "")


def snippet_noise(text: Column) -> Column:
    """Runs of white space and ellipses become one blank."""
    return F.trim(F.regexp_replace(text, r"(\s|\.\.\.|…)+", " "))


def highlight(text: Column, pattern: str, tag: str = "B") -> Column:
    return F.regexp_replace(text, f"(?i)\\b({pattern})\\b", f"<{tag}>$1</{tag}>")


def best_fragment(text: Column, pattern: str, size: int = 300) -> Column:
    """(hits, at, fragment): of the consecutive fragments of `size` the first with the most hits."""
    number = F.ceil(F.greatest(F.length(text), F.lit(1)) / size).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), number - 1),
        lambda k: F.struct(
            F.regexp_count(F.substring(text, k * size + 1, F.lit(size)), F.lit(f"(?i)\\b({pattern})\\b")).alias("hits"),
            (-k).alias("at"),
            F.substring(text, k * size + 1, F.lit(size)).alias("fragment"),
        ),
    )
    return F.array_max(parts)


def bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def bigram_count(text: Column, gram: Column) -> Column:
    """Places where two characters stand, overlapping ones included."""
    apart = ((F.length(text) - F.length(F.replace(text, gram, F.lit("")))) / 2).cast("int")
    return F.when(F.substring(gram, 1, 1) != F.substring(gram, 2, 1), apart).otherwise(F.regexp_count(text, F.concat(F.lit("(?=\\Q"), gram, F.lit("\\E)"))))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of the bigram multisets of two bare() texts: 2 * shared / all.

    Each distinct bigram of b is counted in both, so b is the shorter text.
    """
    pairs = F.greatest(F.length(b) - 1, F.lit(0))
    grams = F.when(pairs > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(pairs, F.lit(1))), lambda i: F.substring(b, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    shared = F.aggregate(grams, F.lit(0), lambda s, g: s + F.least(bigram_count(a, g), bigram_count(b, g)))
    total = pairs + F.greatest(F.length(a) - 1, F.lit(0))
    return F.when(total > 0, F.try_divide(2.0 * shared, total)).otherwise(0.0)


def json_values(text: Column) -> Column:
    """The whole JSON objects and arrays within free text, in order; what is within one is not listed again.

    A bracket automaton folds over the text's pieces: it keeps the places of open brackets, and is aware of strings and
    escapes within them. Every balanced pair is a candidate; those are taken from the left that parse. A closing
    bracket of the wrong kind, or a line's end within a string, ends what is open: no JSON goes on there.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'[^"\\{}\[\]\n]+|[\s\S]'), F.lit(0))
    places, pairs = F.array().cast("array<int>"), F.array().cast("array<struct<start: int, end: int>>")
    off = F.lit(False)
    start = F.struct(F.lit(0).alias("at"), places.alias("open"), F.lit("").alias("kinds"), off.alias("quoted"), off.alias("escaped"), pairs.alias("pairs"))

    def step(s: Column, p: Column) -> Column:
        out = ~s["quoted"]
        opens, closes = out & p.isin("{", "["), out & p.isin("}", "]")
        fits = closes & (F.right(s["kinds"], F.lit(1)) == F.when(p == "}", "{").otherwise("["))
        lost = (closes & ~fits) | (s["quoted"] & (p == "\n"))
        depth = F.size(s["open"])
        return F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when(lost, places).when(opens, F.array_append(s["open"], s["at"])).when(fits, F.slice(s["open"], 1, depth - 1)).otherwise(s["open"]).alias("open"),
            F.when(lost, "").when(opens, F.concat(s["kinds"], p)).when(fits, F.left(s["kinds"], depth - 1)).otherwise(s["kinds"]).alias("kinds"),
            F.when(lost, off).when((p == '"') & ~s["escaped"], out & (depth > 0)).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (p == "\\")).alias("escaped"),
            F.when(fits, F.array_append(s["pairs"], F.struct(F.element_at(s["open"], -1).alias("start"), s["at"].alias("end")))).otherwise(s["pairs"]).alias("pairs"),
        )

    def take(s: Column, x: Column) -> Column:
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"] + 1)
        new = F.struct(x["end"].alias("upto"), F.array_append(s["found"], value).alias("found"))
        return F.when(x["start"] < s["upto"], s).when(F.try_parse_json(value).isNotNull(), new).otherwise(s)

    none = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(F.sort_array(F.aggregate(pieces, start, step)["pairs"]), none, take, lambda s: s["found"])


SCALAR = r'(?s)^("([^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false|null)$'


def fenced_json(text: Column) -> Column:
    """What a ```json block holds, else empty."""
    return F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)


def json_candidate(text: Column) -> Column:
    """JSON within free text: the first whole value of a fenced block, else of the text."""
    fenced = fenced_json(text)
    scalar = F.when(fenced.rlike(SCALAR) & F.try_parse_json(fenced).isNotNull(), fenced)
    return F.coalesce(F.get(json_values(fenced), F.lit(0)), scalar, F.get(json_values(text), F.lit(0)))


ANSWER = "answer ARRAY<STRUCT<fact: STRING, id: STRING>>"


def parsed_facts(response: Column) -> Column:
    """(fact, id) of the first whole value of a response that holds facts, a fenced block before the rest.

    Unknown keys are ignored, quoted ids are read; a response without facts is empty.
    """

    def facts(body: Column) -> Column:
        rows = F.when(F.left(body, F.lit(1)) == "[", F.from_json(body, "ARRAY<STRUCT<fact: STRING, id: STRING>>")).otherwise(F.from_json(body, f"STRUCT<{ANSWER}>")["answer"])
        return F.transform(
            F.filter(F.coalesce(rows, F.array()), lambda x: x["fact"].isNotNull() & (F.trim(x["fact"]) != "")),
            lambda x: F.struct(x["fact"].alias("fact"), x["id"].try_cast("long").alias("id")),
        )

    found = F.filter(F.transform(F.concat(json_values(fenced_json(response)), json_values(response)), facts), lambda x: F.size(x) > 0)
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<struct<fact: string, id: bigint>>"))
