"""Ranking passages for a question; every order is total (file, page, chunk, id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.operators.scoring import relevance

PLACE = ("source_file", "page_number", "chunk_index", "passage_id")


def place_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in PLACE]


def best_first() -> list[Column]:
    return [F.desc("score"), *place_order()]


def score(passages: DataFrame, terms: Sequence[str]) -> DataFrame:
    return passages.withColumn("score", relevance(F.col("text"), terms))


def per_file(scored: DataFrame, limit: int) -> DataFrame:
    """The best `limit` passages of each file with a score above 0, with `rank`; partial ranks are cut before the shuffle."""
    w = Window.partitionBy("source_file").orderBy(*best_first())
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top(scored: DataFrame, k: int, limit: int | None = None) -> DataFrame:
    """The best k passages overall, at most `limit` of one file; k = 0 gives none."""
    kept = scored.where("score > 0") if limit is None else per_file(scored, limit).drop("rank")
    return kept.orderBy(*best_first()).limit(k)


def gate(ranked: DataFrame, least: float) -> DataFrame:
    """Files whose best passage reaches the least score keep their passages; the rank is at hand, so no further shuffle."""
    return ranked.withColumn("best", F.max("score").over(Window.partitionBy("source_file"))).where(F.col("best") >= least).drop("best")


def contexts(ranked: DataFrame) -> DataFrame:
    """One row per file: its passages as an array in rank order. Bounded by the limit of per_file.

    Rows are few and short but dear to work on, so they are spread over as many tasks as a shuffle has: by a hash of
    the file, as a repartition by the file itself would be dropped after the aggregate and its few bytes coalesced.
    """
    spread = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = F.struct("rank", "passage_id", "source_file", "source_path", "page_number", "score", "text")
    return ranked.groupBy("source_file").agg(F.array_sort(F.collect_list(fields)).alias("passages")).repartition(spread, F.xxhash64("source_file"))


def joined_text(passages: Column, glue: str) -> Column:
    return F.array_join(F.transform(passages, lambda p: F.coalesce(p["text"], F.lit(""))), glue)
