"""Expansion of a question into terms, and lexical relevance."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigrain.functions.text import array_of, let, quoted, tokens
from evigrain.lexicon import BONUSES, DEFAULT_TERMS, EXPANSIONS, STOPWORDS
from evigrain.schemas import EVIDENCE_COLUMNS


def expand(question: str | None) -> list[str]:
    """Terms of a constant question, computed once on the driver: words without stopwords, and the expansions of the keys it contains."""
    low = (question or "").lower()
    terms = dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9-]{1,}", question or "") if w.lower() not in STOPWORDS)
    for key, more in EXPANSIONS.items():
        if re.search(rf"\b{key}\b", low) if len(key) <= 2 else key in low:
            terms |= dict.fromkeys(more)
    return list(terms) or list(DEFAULT_TERMS)


def expand_column(c: Column) -> Column:
    """The same for a question in a column, as an array of distinct terms."""
    words = F.array_except(tokens(c), array_of(STOPWORDS))
    none = F.array().cast("array<string>")
    named = lambda low, k: low.rlike(rf"(?U)\b{k}\b") if len(k) <= 2 else F.contains(low, F.lit(k))
    more = let(F.lower(F.coalesce(c, F.lit(""))), lambda low: F.concat(*(F.when(named(low, k), array_of(v)).otherwise(none) for k, v in EXPANSIONS.items())))
    return let(F.array_distinct(F.concat(words, more)), lambda t: F.when(F.size(t) > 0, t).otherwise(array_of(DEFAULT_TERMS)))


def _bonus(low: Column) -> Column:
    total = F.lit(0.0)
    for phrase, bonus in BONUSES.items():
        total = total + F.when(F.contains(low, F.lit(phrase)), bonus).otherwise(0.0)
    return total


def relevance(text: Column, terms: Sequence[str]) -> Column:
    """Score of a text for constant terms: phrases count 4, words 1.25 each up to five, and a bonus for certain phrases.

    Every addend is a multiple of 0.25, so the sum is exact in any order.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for term in map(str.lower, terms):
        if " " in term:
            total = total + F.when(F.contains(low, F.lit(term)), 4.0).otherwise(0.0)
        else:
            # Most texts lack most terms: a plain search keeps the pattern from them.
            total = total + F.when(F.contains(low, F.lit(term)), F.least(F.regexp_count(low, F.lit(rf"(?U)\b{quoted(term)}\b")), F.lit(5)) * 1.25).otherwise(0.0)
    return total + _bonus(low)


def relevance_to(text: Column, terms: Column) -> Column:
    """The same for terms in an array column."""

    # Words of the text are split once and compared; a pattern made from a term would be compiled anew for each row. Only terms with a hyphen need one.
    words = lambda low: F.split(low, r"[^\p{L}\p{N}\p{M}_]+", -1)

    def one(low: Column, ws: Column, t: Column) -> Column:
        phrase = F.when(F.contains(low, t), 4.0).otherwise(0.0)
        joint = F.regexp_count(low, F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b")))
        times = F.when(F.contains(t, F.lit("-")), F.when(F.contains(low, t), joint).otherwise(0)).otherwise(F.size(F.filter(ws, lambda w: w == t)))
        return F.when(F.contains(t, F.lit(" ")), phrase).otherwise(F.least(times, F.lit(5)) * 1.25)

    total = lambda low, ws: F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + one(low, ws, t)) + _bonus(low)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(words(low), lambda ws: total(low, ws)))


def row_relevance(terms: Sequence[str], columns: Sequence[str] = tuple(EVIDENCE_COLUMNS)) -> Column:
    """Score of an evidence row: of all its values in one text."""
    return relevance(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)), terms)
