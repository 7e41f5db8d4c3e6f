"""Ignore globs as regular expressions, built once on the driver and used as a column predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_of(glob: str) -> str:
    """A whole-path expression: ** crosses directories, * and ? don't, [..] is a class."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body.startswith("!") else body
            out.append("[" + body.replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def expand(pattern: str) -> list[str]:
    """The globs a pattern stands for: a match here or in any directory, and all that lies below it.

    A pattern that begins with *. names files and has nothing below it.
    """
    name = pattern.strip().removeprefix("/").removesuffix("/").removeprefix("**/")
    if not name:
        return []
    places = [name, f"**/{name}"]
    return places if name.startswith("*.") else [g for p in places for g in (p, f"{p}/**")]


def ignore_regex(patterns: list[str]) -> str:
    """One expression for all patterns, matched on paths relative to the monitored root."""
    globs = list(dict.fromkeys(g for p in patterns for g in expand(p)))
    return "^(?:" + "|".join(regex_of(g) for g in globs) + ")$" if globs else r"^\b$"


def ignored(path: Column, patterns: list[str]) -> Column:
    return F.regexp_replace(path, "^/+", "").rlike(ignore_regex(patterns))


def valid(pattern: Column) -> Column:
    """Whether a trimmed pattern starts with a name, *, . or / and holds nothing else but names, blanks, brackets, *, ?, ! and -."""
    return pattern.rlike(r"^[A-Za-z0-9_*./\[][A-Za-z0-9_*./\[\]\-!? ]*$")


def validate(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(valid, invalid): trimmed, blanks dropped, repeats dropped; a pattern starts with a name, *, . or /."""
    seen = list(dict.fromkeys(p.strip() for p in patterns if p and p.strip()))
    good = [p for p in seen if re.match(r"[A-Za-z0-9_*./\[]", p) and re.fullmatch(r"[A-Za-z0-9_*./\[\]\-!? ]+", p)]
    return good, [p for p in seen if p not in good]
