"""Shell patterns over paths, as anchored regular expressions for both Java and Python.

`*` and `?` stay within one segment, `[a-z]` and `[^a-z]` are classes, a backslash takes the next character as it is, and the whole string has to match. A
malformed pattern matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"(?P<star>\*+)|(?P<one>\?)|\[(?P<no>\^?)(?P<set>(?:\\.|[^\\\]-])(?:-(?:\\.|[^\\\]-]))?(?:(?:\\.|[^\\\]-])(?:-(?:\\.|[^\\\]-]))?)*)\]|\\(?P<plain>.)|(?P<other>[^\\\[*?])", re.S)


def _code(char: str) -> str:
    return rf"\x{ord(char):02x}" if ord(char) < 256 else char


def regex_of(pattern: str) -> str | None:
    """The expression, or None for a malformed pattern."""
    out, at = [], 0
    while at < len(pattern):
        m = TOKEN.match(pattern, at)
        if m is None:
            return None
        at = m.end()
        if m["star"]:
            out.append("[^/]*")
        elif m["one"]:
            out.append("[^/]")
        elif m["set"]:
            members = re.findall(r"\\(.)|([^\\])", m["set"], re.S)
            # an escaped hyphen is a member, a bare one parts the ends of a range
            out.append("[" + m["no"] + "".join("-" if bare == "-" else _code(kept or bare) for kept, bare in members) + "]")
        else:
            out.append(_code(m["plain"] or m["other"]))
    return "(?s)\\A" + "".join(out) + "\\z"


def matches(value: Column, pattern: str) -> Column:
    expression = regex_of(pattern)
    return F.lit(False) if expression is None else value.rlike(expression)


def matches_types(value: Column, patterns: list[str] | None) -> Column:
    """A list of type patterns: those that begin with `-` exclude and win; without a positive one everything else is in."""
    if not patterns:
        return F.lit(True)
    wanted, refused = [p for p in patterns if not p.startswith("-")], [p[1:] for p in patterns if p.startswith("-")]
    out = F.lit(not wanted)
    for p in wanted:
        out = out | matches(value, p)
    for p in refused:
        out = out & ~matches(value, p)
    return out
