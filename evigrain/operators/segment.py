"""Pages into overlapping passages.

Units are the paragraphs of a page, those over the limit as their sentences.  Units are gathered until the
next would exceed the limit; a finished passage hands its last characters on to the next.  A unit that is
too long itself stays whole, and no passage crosses pages.  Two forms with one contract: a fold of built-in
expressions, and Arrow batches, which is faster on long pages and the default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions.text import SPACE_CHARS, collapsed, sentences, trimmed
from evigrain.schemas import MISSING

LIMIT, OVERLAP = 2400, 250
_PARTS = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def units_of(text: Column, limit: int) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n(?U:\\s)*\n", -1), trimmed), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > limit, sentences(p)).otherwise(F.array(p))))


def fold_passages(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Passages of a page as an array, by a fold over its units."""
    state = "struct<out:array<string>,cur:string,n:int,any:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("any")).cast(state)

    def step(acc: Column, unit: Column) -> Column:
        full = acc["any"] & (acc["n"] + F.length(unit) + 1 > limit)
        whole = collapsed(acc["cur"])
        tail = F.when((F.length(whole) > overlap) & F.lit(overlap > 0), F.right(whole, F.lit(overlap)))
        out = F.when(full & (whole != ""), F.concat(acc["out"], F.array(whole))).otherwise(acc["out"])
        cur = F.when(full, F.coalesce(F.concat(tail, F.lit("\n"), unit), unit)).when(acc["any"], F.concat(acc["cur"], F.lit("\n"), unit)).otherwise(unit)
        n = F.when(full, F.coalesce(F.length(tail), F.lit(0))).otherwise(acc["n"]) + F.length(unit) + 1
        return F.struct(out.alias("out"), cur.alias("cur"), n.cast("int").alias("n"), F.lit(True).alias("any"))

    end = lambda acc: F.when(collapsed(acc["cur"]) != "", F.concat(acc["out"], F.array(collapsed(acc["cur"])))).otherwise(acc["out"])
    return F.aggregate(units_of(text, limit), start, step, end)


def passages_of(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Passages of one page; the body of the Arrow form."""
    out: list[str] = []
    current: list[str] = []
    size = 0
    for part in _PARTS.split(text or ""):
        part = part.strip(SPACE_CHARS)
        for unit in [u for u in (s.strip() for s in _SENTENCE.split(" ".join(part.split()))) if u] if len(part) > limit else [part] if part else []:
            if current and size + len(unit) + 1 > limit:
                whole = " ".join(" ".join(current).split())
                if whole:
                    out.append(whole)
                tail = whole[-overlap:] if 0 < overlap < len(whole) else None
                current, size = ([tail], len(tail)) if tail else ([], 0)
            current.append(unit)
            size += len(unit) + 1
    whole = " ".join(" ".join(current).split())
    return [*out, whole] if whole else out


def page_names(pages: DataFrame) -> DataFrame:
    """pages with source_file, source_path, stem and page as text, defaults filled in."""
    path = F.nullif(F.col("file_path"), F.lit(""))
    file = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.nullif(F.regexp_extract(path, "[^/]*$", 0), F.lit("")), F.lit("unknown"))
    page = F.coalesce(F.nullif(F.col("page_number"), F.lit(0)).cast("string"), F.nullif(F.col("page_label"), F.lit("")), F.lit(MISSING))
    stem = F.regexp_replace(F.col("source_file"), r"(?<=[^/])\.[^./]*$", "")
    return pages.withColumns({"source_file": file, "source_path": F.coalesce(path, F.lit("")), "page": page}).withColumn("stem", stem)


def segment(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, fold: bool = False) -> DataFrame:
    """pages as passages (passage_id, source_file, source_path, page_number, chunk_index, text, score).

    A page without text gives no passage; each page is cut by itself, so there is no shuffle.
    """
    named = page_names(pages).select("source_file", "source_path", "stem", "page", "page_number", "text")
    if fold:
        cut = named.select("*", F.posexplode(fold_passages(F.col("text"), limit, overlap)).alias("chunk", "passage")).withColumn("chunk_index", F.col("chunk") + 1)
    else:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [passages_of(t, limit, overlap) for t in batch.column(5).to_pylist()]
                parent = pa.array([i for i, own in enumerate(lists) for _ in own], pa.int64())
                rest = [c.take(parent) for c in batch.columns[:5]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([i for own in lists for i in range(1, len(own) + 1)], pa.int32()), pa.array([p for own in lists for p in own], pa.string())], names=names)

        names = ["source_file", "source_path", "stem", "page", "page_number", "chunk_index", "passage"]
        cut = named.mapInArrow(split, "source_file string, source_path string, stem string, page string, page_number int, chunk_index int, passage string")
    return cut.select(F.concat(F.col("stem"), F.lit(":p"), F.col("page"), F.lit(":c"), F.col("chunk_index")).alias("passage_id"), "source_file", "source_path", "page_number", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("passage").alias("text"), F.lit(0.0).alias("score"))
