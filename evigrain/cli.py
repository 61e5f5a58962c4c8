"""Command line: build an evidence table from a folder of PDF files."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from evigrain.lexicon import DEFAULT_QUESTION
from evigrain.plans.atlas import build
from evigrain.sources.backends import BACKENDS, Chat, load_env, service, usable
from evigrain.sources.pages import MODES, POLICIES, VisionReader, read_pages
from evigrain.sources.tables import show_summary, write_audit, write_evidence


MODEL = "openai/gpt-4o-mini"  # fixed value


# The names of the flags and of the variables, and the defaults.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--articles", default="./articles")
    p.add_argument("--query", default=DEFAULT_QUESTION)
    p.add_argument("--output", default="sepsis_atlas_results.csv", help="folder of the CSV table")
    p.add_argument("--evidence-jsonl", default="evidence_passages.jsonl", help="folder of the passages cited")
    p.add_argument("--backend", choices=BACKENDS, default="llm")
    p.add_argument("--model", default=os.environ.get("OPENROUTER_MODEL", MODEL))
    p.add_argument("--top-k-per-study", type=int, default=8)
    p.add_argument("--min-score", type=float, default=1.0)
    p.add_argument("--max-pages-per-pdf", type=int, default=0)
    p.add_argument("--workers", type=int, default=int(os.environ.get("ATLAS_WORKERS", "4")))
    p.add_argument("--parse-workers", type=int, default=0, help="partitions while decoding; 0 leaves it to Spark")
    p.add_argument("--vision-mode", choices=MODES, default=os.environ.get("ATLAS_VISION_MODE", "auto"))
    p.add_argument("--vision-model", default=os.environ.get("OPENROUTER_VISION_MODEL"))
    p.add_argument("--vision-dpi", type=int, default=144)
    p.add_argument("--min-text-chars-for-vision", type=int, default=500)
    p.add_argument("--vision-error-policy", choices=POLICIES, default=os.environ.get("ATLAS_VISION_ERROR_POLICY", "warn"))
    return p


def main(argv: list[str] | None = None, extractor=None, reader=None, **decoder) -> int:
    """Builds the table. Without a usable key the llm backend is an error, auto falls back on patterns, and pages that need vision are tagged with an error."""
    load_env()
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("evidence").getOrCreate()
    keys = service()
    vision_model = a.vision_model or os.environ.get("OPENROUTER_MODEL", MODEL)
    if a.vision_mode != "off" and reader is None:
        reader = VisionReader(vision_model, keys if usable(os.environ.get("OPENROUTER_API_KEY")) else None, a.vision_dpi)
    if a.backend != "regex" and extractor is None:
        extractor = Chat(a.model, keys)
        if keys is None and a.backend == "llm":
            raise RuntimeError("the llm backend needs a usable OPENROUTER_API_KEY or OPENAI_API_KEY")
    pages = read_pages(spark, a.articles, max_pages=a.max_pages_per_pdf, vision=a.vision_mode, reader=reader, model=vision_model, least_chars=a.min_text_chars_for_vision, policy=a.vision_error_policy, **decoder)
    if a.parse_workers:
        pages = pages.repartition(a.parse_workers)
    pages = pages.persist()
    if pages.isEmpty():
        raise FileNotFoundError(f"no PDF pages with text in {a.articles}")
    built = build(pages, a.query, a.top_k_per_study, a.min_score, a.backend, extractor, a.workers)
    evidence = built.evidence.persist()
    if evidence.isEmpty():
        raise RuntimeError("no evidence rows were extracted")
    write_evidence(evidence, a.output)
    write_audit(built.ranked, a.evidence_jsonl)
    show_summary(evidence)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
