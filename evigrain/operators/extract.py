"""Study-level fields by patterns, each a Column over a study's text; null where nothing is found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigrain import lexicon as lex
from evigrain.functions.text import all_hits, array_of, collapsed, flagged, names_found, sentences, unique_join


def population(text: Column) -> Column:
    has = lambda s: F.exists(array_of(lex.POPULATION_WORDS), lambda w: F.contains(F.lower(s), w))
    return F.nullif(collapsed(F.substring(F.get(F.filter(sentences(text), has), F.lit(0)), 1, 260)), F.lit(""))


def sample_size(text: Column) -> Column:
    return unique_join(F.concat(all_hits(text, lex.SAMPLE_PATTERNS, 4), all_hits(text, lex.DEATH_PATTERNS, 2)), 5)


def predictors(text: Column, terms: Sequence[str]) -> Column:
    """Names found, those akin to a term of the question first."""
    akin = [n for n, _ in lex.PREDICTORS if any(t.lower() in n.lower() or n.lower() in t.lower() for t in terms)]
    found = names_found(text, lex.PREDICTORS)
    return unique_join(F.concat(F.filter(found, lambda n: F.array_contains(array_of(akin), n)), found) if akin else found, 6)


def outcome(text: Column) -> Column:
    sentence = F.get(F.filter(sentences(text), lambda s: s.rlike(flagged(lex.OUTCOME_SENTENCE))), F.lit(0))
    return F.coalesce(unique_join(all_hits(text, lex.OUTCOME_PATTERNS, 3), 3), F.nullif(collapsed(F.substring(sentence, 1, 220)), F.lit("")))


def method(text: Column) -> Column:
    return unique_join(names_found(text, lex.METHODS), 5)


def timing(text: Column) -> Column:
    return unique_join(all_hits(text, lex.TIMING_PATTERNS, 3), 3)


def effect_size(text: Column) -> Column:
    return unique_join(all_hits(text, lex.EFFECT_PATTERNS, 6), 6)


def performance(text: Column) -> Column:
    return unique_join(all_hits(text, lex.PERFORMANCE_PATTERNS, 8), 8)


def fields(text: Column, terms: Sequence[str]) -> dict[str, Column]:
    return {
        "population": population(text), "sample_size": sample_size(text), "predictor": predictors(text, terms), "outcome": outcome(text),
        "timing": timing(text), "method": method(text), "effect_size": effect_size(text), "performance": performance(text),
    }
