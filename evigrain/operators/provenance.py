"""Anchors: the sentences that a value comes from, the passage they stand in, a link to the page, and the file of a row."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions.text import array_of, collapsed, let, sentences, tokens
from evigrain.lexicon import ANCHOR_TERMS, STOPWORDS
from evigrain.operators.scoring import expand_column, relevance_to
from evigrain.schemas import MISSING, SOURCE_FIELDS

CUT = 700


def windows(text: Column) -> Column:
    """Each sentence with its neighbours."""
    around = lambda s, i: F.array_join(F.slice(s, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")
    return let(sentences(text), lambda s: F.transform(s, lambda _, i: around(s, i)))


def first_best(candidates: Column, score) -> Column:
    """The first candidate with the highest score; null without candidates."""
    ranked = F.transform(candidates, lambda w, i: F.struct(score(w).cast("double").alias("score"), (-i).alias("place"), w.alias("window")))
    return F.array_max(ranked)["window"]


def anchor_terms(predictor: Column, outcome: Column) -> Column:
    """The terms of both values and the fixed ones, sorted, joined and expanded again."""
    both = F.concat(F.coalesce(predictor, F.lit("")), F.lit(" "), F.coalesce(outcome, F.lit("")))
    return expand_column(F.array_join(F.array_sort(F.array_union(expand_column(both), array_of(ANCHOR_TERMS))), " "))


def best_anchor(text: Column, predictor: Column, outcome: Column, effect: Column, performance: Column) -> Column:
    """The window that fits the row best; a quoted effect or performance counts 5."""
    said = lambda v: F.when((v != MISSING) & (v != ""), F.lower(v))
    sought = F.struct(anchor_terms(predictor, outcome).alias("terms"), said(effect).alias("effect"), said(performance).alias("performance"))

    def score(w: Column, v: Column) -> Column:
        quoted = let(F.lower(w), lambda low: F.coalesce(F.contains(low, v["effect"]), F.lit(False)) | F.coalesce(F.contains(low, v["performance"]), F.lit(False)))
        return relevance_to(w, v["terms"]) + F.when(quoted, 5.0).otherwise(0.0)

    best = let(sought, lambda v: first_best(windows(text), lambda w: score(w, v)))
    return F.nullif(collapsed(F.substring(best, 1, CUT)), F.lit(""))


def value_anchor(text: Column, value: Column, fallback: Column) -> Column:
    """The window of the text that a single value comes from: 3 a number, 1 a word, 8 the whole value."""
    return let(windows(text), lambda found: value_window(found, value, fallback))


def value_window(found: Column, value: Column, fallback: Column) -> Column:
    """The same, given the windows."""
    bare = collapsed(value)
    numbers = F.regexp_extract_all(bare, F.lit(r"(?U)(\d+(?:\.\d+)?)"), 1)
    words = F.array_distinct(F.slice(F.filter(tokens(bare), lambda w: (F.length(w) > 2) & ~F.array_contains(array_of(STOPWORDS), w)), 1, 10))
    sought = F.struct(F.lower(bare).alias("whole"), numbers.alias("numbers"), words.alias("words"))

    def score(w: Column, v: Column) -> Column:
        hits = lambda low: F.size(F.filter(v["words"], lambda x: F.contains(low, x))) + F.when(F.contains(low, v["whole"]), 8).otherwise(0)
        return F.size(F.filter(v["numbers"], lambda n: F.contains(w, n))) * 3 + let(F.lower(w), hits)

    best = F.nullif(collapsed(F.substring(let(sought, lambda v: first_best(found, lambda w: score(w, v))), 1, CUT)), F.lit(""))
    return F.when((bare != "") & (bare != MISSING), F.coalesce(best, fallback))


def field_sources(text: Column, fallback: Column, values: dict[str, Column]) -> Column:
    """A map of field to anchor for the fields that have a value."""
    given = F.array(*(F.struct(F.lit(f).alias("key"), values[f].alias("value")) for f in SOURCE_FIELDS))
    anchored = let(windows(text), lambda found: F.transform(given, lambda p: F.struct(p["key"].alias("key"), value_window(found, p["value"], fallback).alias("value"))))
    return F.map_from_entries(F.filter(anchored, lambda p: p["value"].isNotNull()))


def anchor_passage(anchor: Column, passages: Column) -> Column:
    """The first passage (best first) that contains the anchor, else the first."""
    inside = F.filter(passages, lambda p: F.contains(F.lower(p["text"]), F.lower(anchor)))
    return F.coalesce(F.get(inside, F.lit(0)), F.get(passages, F.lit(0)))


def page_of(value: Column) -> Column:
    """A page number from text: 3.7 is 3, what is no finite number is null."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 2147483648.0), number.cast("int"))


def absolute(path: Column) -> Column:
    """A path without its file scheme, from the root; a relative one belongs to the folder the program runs in. Other schemes stay."""
    bare = F.regexp_replace(path, "^file:/*", "/")
    return F.when(bare.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), bare).otherwise(F.concat(F.lit(os.getcwd().rstrip("/") + "/"), bare))


def file_uri(path: Column) -> Column:
    """An absolute path as a URI, percent-encoded; a path of another scheme as it is."""
    encoded = F.url_encode(path)
    for form, char in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(char))
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("file://"), encoded)).otherwise(path)


def source_link(path: Column, page: Column) -> Column:
    """A link to a page of a file that exists; page 0 and unknown pages have no fragment; MISSING without a path."""
    number = page_of(page)
    fragment = F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(F.lit("#page="), number)).otherwise("")
    return F.coalesce(F.concat(file_uri(absolute(F.nullif(path, F.lit("")))), fragment), F.lit(MISSING))


def pdf_candidates(link: Column, file: Column, study: Column, folder: str) -> Column:
    """Where a row's file may be, first choice first: its file link, its source_file as a path, that and the study's name (with .pdf) in the articles folder."""
    named = lambda c: F.when((c != "") & (c != MISSING), c)
    within = lambda c: F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), c))
    encoded = F.replace(F.regexp_extract(link, "^file://[^/]*(/[^?#]*)", 1), F.lit("+"), F.lit("%2B"))
    linked = F.when(F.startswith(link, F.lit("file://")), F.nullif(F.coalesce(F.try_url_decode(encoded), encoded), F.lit("")))
    by_study = within(named(study))
    return F.array_compact(F.array(linked, absolute(named(file)), within(named(file)), by_study, F.when(~F.endswith(F.lower(study), F.lit(".pdf")), F.concat(by_study, F.lit(".pdf")))))


def with_pdf(rows: DataFrame, files: DataFrame, folder: str = "articles") -> DataFrame:
    """rows with pdf_path, the first candidate among the known files (one column of paths); null if none is.

    Rows meet the files by the few columns that name one, each combination once.
    """
    folder = folder if "://" in folder or folder.startswith("/") else os.path.abspath(folder)
    names = ["source_link", "source_file", "study_name"]
    known = files.select(absolute(files[files.columns[0]]).alias("_path")).distinct()
    asked = rows.select(*(F.col(n).alias(f"_{n}") for n in names)).distinct()
    tried = asked.select("*", F.posexplode(pdf_candidates(*(F.col(f"_{n}") for n in names), folder)).alias("_place", "_path"))
    found = tried.join(known, "_path").groupBy(*(f"_{n}" for n in names)).agg(F.min_by("_path", "_place").alias("pdf_path"))
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return rows.drop("pdf_path").join(found, same[0] & same[1] & same[2], "left").drop(*(f"_{n}" for n in names))
