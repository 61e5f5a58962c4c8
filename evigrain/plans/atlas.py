"""The two programs: building an evidence table from pages, and asking it a question."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from evigrain.operators import retrieve, table
from evigrain.operators.scoring import expand
from evigrain.operators.segment import segment
from evigrain.sources.backends import Extractor, extract_rows


@dataclass
class Built:
    evidence: DataFrame
    ranked: DataFrame


def build(pages: DataFrame, question: str, top_k: int = 8, min_score: float = 1.0, backend: str = "regex", extractor: Extractor | None = None, workers: int = 4) -> Built:
    """pages to evidence: segment, score, best passages of each file, gate, extract, order. One shuffle, by file, carries the best passages only."""
    scored = retrieve.score(segment(pages), expand(question))
    ranked = retrieve.gate(retrieve.per_file(scored, top_k), min_score)
    rows = extract_rows(retrieve.contexts(ranked), question, backend, extractor, workers)
    return Built(table.in_order(rows), ranked)


@dataclass
class Answer:
    ranked: DataFrame
    shown: DataFrame
    metrics: DataFrame
    review: DataFrame


def ask(evidence: DataFrame, question: str, **facets: Sequence[str]) -> Answer:
    """A question to a repaired table: ranked as a whole, then filtered, measured and reviewed."""
    found = table.facet_filter(table.relevant(evidence, question), **facets)
    ranked = table.in_rank(found)
    return Answer(ranked, table.result_table(ranked), table.result_metrics(found), table.source_review(found))
