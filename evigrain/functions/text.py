"""Text functions, Column to Column; each keeps null as null unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, beyond what a regular expression's \s covers.
SPACES = "\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
SPACE_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once; the body of a lambda would work it out again for every element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapsed(c: Column) -> Column:
    """Null as empty; white space runs as one space, none at the ends."""
    return F.coalesce(F.btrim(F.regexp_replace(c, f"[{SPACES}]+", " ")), F.lit(""))


def clean_page(c: Column) -> Column:
    """Page text as paragraphs parted by blank lines: lines joined, hyphens at line ends removed, blanks collapsed."""
    lines = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "\n"), "[\n\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]", -1)
    tidy = F.array_join(F.transform(lines, lambda x: trimmed(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    glued = F.transform(F.split(tidy, "\n{2,}", -1), lambda p: trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^\n+|\n+$", ""), "-\n", ""), "[ \t\n]+", " ")))
    return F.array_join(F.filter(glued, lambda p: p != ""), "\n\n")


def sentences(c: Column) -> Column:
    """Sentences of the collapsed text: a cut after . ! ? before a Latin capital or digit."""
    return F.filter(F.transform(F.split(collapsed(c), r"(?<=[.!?])\s+(?=[A-Z0-9])", -1), lambda s: F.btrim(s)), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Latin words of two characters or more, lower case, duplicates kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9-]{1,})"), 1), F.lower)


def unique_join(values: Column, limit: int | None = 6) -> Column:
    """The first `limit` distinct values (ignoring case, blanks dropped) joined by "; "; null if there are none."""
    first = let(F.transform(values, collapsed), lambda t: let(F.transform(t, F.lower), lambda low: F.filter(t, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1))))
    return F.nullif(F.array_join(first if limit is None else F.slice(first, 1, limit), "; "), F.lit(""))


def flagged(pattern: str) -> str:
    """A pattern without regard to case, with Unicode word boundaries and classes."""
    return "(?iU)" + pattern


def all_hits(c: Column, patterns: Sequence[str], limit: int = 6) -> Column:
    """Matches of the patterns one after the other, cut to `limit` before anything is made unique."""
    found = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(flagged(p)), 0) for p in patterns)))
    return F.slice(F.transform(found, collapsed), 1, limit)


def first_hit(c: Column, patterns: Sequence[str]) -> Column:
    """The first match of the first pattern that has one; null if none has."""
    return F.coalesce(*(F.nullif(collapsed(F.regexp_extract(c, flagged(p), 0)), F.lit("")) for p in patterns))


def names_found(c: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Names whose pattern matches, in order."""
    return F.filter(F.array(*(F.when(c.rlike(flagged(p)), F.lit(n)) for n, p in patterns)), lambda x: x.isNotNull())


def array_of(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def quoted(term: str) -> str:
    """A term as a literal in a regular expression of either engine."""
    return re.sub(r"([^\w ])", r"\\\1", term)
