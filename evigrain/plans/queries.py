"""Queries of the core: (spark, folder) -> DataFrame, by name. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.functions.stages import settled
from evigrain.functions.text import clean_page, sentences, tokens
from evigrain.lexicon import DEFAULT_QUESTION
from evigrain.operators import extract, retrieve
from evigrain.operators import table as evidence
from evigrain.operators.packed import split_packed
from evigrain.operators.provenance import anchor_passage, best_anchor, field_sources, source_link, value_anchor, with_pdf
from evigrain.operators.scoring import expand, expand_column
from evigrain.operators.segment import segment
from evigrain.operators.validate import sources_map, with_support
from evigrain.plans.atlas import build
from evigrain.plans.tables import delivered_once, small_rows, table, term_names
from evigrain.schemas import EVIDENCE_COLUMNS, MISSING, PAGE
from evigrain.sources.backends import regex_rows
from evigrain.sources.pages import wants_vision

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TERMS = expand(DEFAULT_QUESTION)
UNKNOWN_QUESTION = "zzyzx qwxv"
ARTICLES = "/srv/atlas/articles"  # the folder that the pages of the test tables come from
PAGE_COLUMNS = ["page_id", *PAGE.fieldNames()]
PASSAGE_COLUMNS = ["passage_id", "source_file", "source_path", "page_number", "chunk_index", "text"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage once, though it was delivered again."""
    return delivered_once(spark, folder, "passage", *PASSAGE_COLUMNS)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return delivered_once(spark, folder, "page_document", *PAGE_COLUMNS)


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each evidence row once, missing cells as the sentinel."""
    kept = delivered_once(spark, folder, "sepsis_atlas_results", "row_id", *EVIDENCE_COLUMNS)
    return kept.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(MISSING)) for c in EVIDENCE_COLUMNS[:-1]})


def ranked(spark: SparkSession, folder: str, k: int = 8) -> DataFrame:
    return retrieve.per_file(retrieve.score(passages(spark, folder), TERMS), k)


def studies(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, passages, text): each file's best passages and their text."""
    return settled(retrieve.contexts(ranked(spark, folder)), {"text": retrieve.joined_text(F.col("passages"), "\n\n")})


@query
def clean_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", clean_page(F.col("text")).alias("clean_text"))


@query
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return passages(spark, folder).select("passage_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).select("passage_id", (F.col("pos") + 1).cast("long").alias("sentence_no"), "sentence")


@query
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    t = tokens(F.col("text"))
    return passages(spark, folder).select("passage_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.coalesce(F.array_join(F.slice(t, 1, 5), " "), F.lit("")).alias("first_tokens"))


@query
def segment_pages(spark: SparkSession, folder: str) -> DataFrame:
    return segment(pages(spark, folder)).select("passage_id", "source_file", "page_number", "chunk_index", "text")


@query
def segment_small(spark: SparkSession, folder: str) -> DataFrame:
    """Short passages, by the fold of built-in expressions."""
    return segment(pages(spark, folder), 300, 40, fold=True).select("passage_id", "chunk_index", "text")


@query
def expand_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a question that each row asks about itself."""
    r = rows(spark, folder)
    return r.select("row_id", F.array_join(F.array_sort(expand_column(F.concat_ws(" ", "predictor", "outcome"))), "|").alias("terms")).distinct()


@query
def score_passages(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve.score(passages(spark, folder), TERMS).select("passage_id", "score")


@query
def retrieve_topk_per_file(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark, folder).select("source_file", "passage_id", "rank", "score")


@query
def retrieve_global_capped(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve.top(retrieve.score(passages(spark, folder), TERMS), 60, 3).select("passage_id", "source_file", "score")


@query
def gate_min_score(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve.gate(ranked(spark, folder), 20.0).select("source_file", "passage_id", "rank")


@query
def study_context(spark: SparkSession, folder: str) -> DataFrame:
    return studies(spark, folder).select("source_file", "text")


@query
def extract_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The eight fields of every study by patterns."""
    return studies(spark, folder).select("source_file", *(c.alias(n) for n, c in extract.fields(F.col("text"), TERMS).items()))


@query
def extract_passage_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern lists over every passage."""
    found = extract.fields(F.col("text"), TERMS)
    return passages(spark, folder).where("text is not null").select("passage_id", *(found[n].alias(n) for n in ("sample_size", "predictor", "outcome", "method", "timing", "effect_size", "performance")))


@query
def sentence_window_anchor(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.fields(F.col("text"), TERMS)
    s = settled(studies(spark, folder), {n: F.coalesce(found[n], F.lit(MISSING)) for n in ("predictor", "outcome", "effect_size", "performance")})
    return s.withColumn("joined", retrieve.joined_text(F.col("passages"), " ")).select("source_file", best_anchor(F.col("joined"), F.col("predictor"), F.col("outcome"), F.col("effect_size"), F.col("performance")).alias("anchor"))


@query
def field_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """The window that each study's population comes from."""
    s = settled(studies(spark, folder), {"population": extract.population(F.col("text"))})
    return s.select("source_file", value_anchor(retrieve.joined_text(F.col("passages"), " "), F.coalesce("population", F.lit(MISSING)), F.lit(MISSING)).alias("anchor"))


@query
def anchor_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The passage in which each study's population stands."""
    s = settled(studies(spark, folder), {"quote": F.coalesce(extract.population(F.col("text")), F.lit(MISSING))})
    return s.select("source_file", anchor_passage(F.col("quote"), F.col("passages"))["passage_id"].alias("passage_id"))


@query
def field_source_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The window that each field of every study comes from."""
    found = extract.fields(F.col("text"), TERMS)
    s = settled(studies(spark, folder), {n: F.coalesce(c, F.lit(MISSING)) for n, c in found.items()})
    anchors = field_sources(retrieve.joined_text(F.col("passages"), " "), F.lit(MISSING), {n: F.col(n) for n in found})
    return s.select("source_file", F.explode(anchors).alias("field", "anchor"))


@query
def evidence_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence row of every study: fields, anchor, source passage, support, in order."""
    made = regex_rows(retrieve.contexts(ranked(spark, folder)), DEFAULT_QUESTION)
    return evidence.in_order(made).select(*(c for c in EVIDENCE_COLUMNS if c != "field_sources_json"))


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that pages were read from."""
    return table(spark, folder, "page_document").select("file_path").where("file_path is not null").distinct()


@query
def resolve_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """The file of each row by every way to name one: a row loses its link, its file or both, by the last digit of its id."""
    kept, last = rows(spark, folder), F.col("row_id") % 5
    stem = F.regexp_replace("source_file", r"\.pdf$", "")
    some = kept.select(
        "row_id",
        F.when(last.isin(0, 4), F.col("source_link")).otherwise(MISSING).alias("source_link"),
        F.when(last == 1, F.concat(F.lit(ARTICLES + "/"), "source_file")).when(last == 2, F.col("source_file")).otherwise(MISSING).alias("source_file"),
        F.when(last == 3, stem).when(last == 4, F.lit("unknown")).otherwise(F.col("study_name")).alias("study_name"),
    )
    return with_pdf(some, known_files(spark, folder), ARTICLES).select("row_id", "pdf_path")


@query
def source_links(spark: SparkSession, folder: str) -> DataFrame:
    named = rows(spark, folder).select("row_id", "source_file", "source_page", F.lit(MISSING).alias("source_link"), F.lit(MISSING).alias("study_name"))
    return with_pdf(named, known_files(spark, folder), ARTICLES).select("row_id", source_link(F.col("pdf_path"), F.col("source_page")).alias("link")).distinct()


@query
def validate_support(spark: SparkSession, folder: str) -> DataFrame:
    return with_support(rows(spark, folder)).select("row_id", "support_status", "support_notes").distinct()


@query
def repair_table(spark: SparkSession, folder: str) -> DataFrame:
    """The table repaired, rows without a status validated."""
    web = F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("https://example.org/"), "source_file")).otherwise(F.col("source_link"))
    gone = F.when(F.col("row_id") % 3 == 0, MISSING)
    kept = rows(spark, folder).withColumns({"support_status": F.when(F.col("support_status") == "partial", "legacy anchor").otherwise(F.col("support_status")), "source_link": web, "source_file": F.coalesce(gone, "source_file"), "study_name": F.coalesce(gone, "study_name"), "source_passage_id": F.lit(MISSING)})
    return evidence.repair(kept, known_files(spark, folder), ARTICLES).select("row_id", "source_file", "source_page", "source_passage_id", "source_link", F.array_join(F.array_sort(F.map_keys(sources_map(F.col("field_sources_json")))), ",").alias("fields"), "support_status").distinct()


@query
def repair_legacy_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table of the oldest form, without any source column."""
    old = rows(spark, folder).select("row_id", "study_name", "predictor", "outcome", "source_anchor")
    return evidence.repair(old).select("row_id", "source_file", "source_page", "source_passage_id", "source_link", "support_status").distinct()


@query
def rank_rows(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.rank(rows(spark, folder), DEFAULT_QUESTION).select("row_id", F.col("_relevance").alias("relevance"), "support_status")


@query
def rank_rows_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A question to which no row is relevant keeps them all."""
    few = rows(spark, folder).select("row_id", *(F.when(F.col(c).rlike("(?i)mortal|death|auc|auroc|odds|hazard|regression|sepsis|septic"), MISSING).otherwise(F.col(c)).alias(c) for c in EVIDENCE_COLUMNS[:-1]), "query_relevance_score")
    return evidence.rank(few, UNKNOWN_QUESTION).select("row_id", F.col("_relevance").alias("relevance"))


@query
def facet_options(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.facet_options(rows(spark, folder), "support_status").unionByName(evidence.facet_options(rows(spark, folder), "method"))


@query
def facet_filter(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.facet_filter(rows(spark, folder), support_status=["supported", "partial"], method=["Neural network", "Poisson regression"], predictor=[]).select("row_id", "study_name", "method", "support_status")


@query
def sidebar_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.sidebar_metrics(rows(spark, folder))


@query
def result_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.result_metrics(evidence.facet_filter(evidence.relevant(rows(spark, folder), DEFAULT_QUESTION), support_status=["supported", "partial"]))


@query
def result_table(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.result_table(evidence.rank(rows(spark, folder), DEFAULT_QUESTION))


@query
def unique_source_review(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct source with the rank value of its first row."""
    return evidence.source_review(evidence.relevant(rows(spark, folder), DEFAULT_QUESTION), None).select("source_key", F.col("_relevance").alias("relevance"), "support_status")


@query
def field_source_groups(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.source_groups(rows(spark, folder), "row_id").select("row_id", "source", "fields")


@query
def source_cards(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.card(rows(spark, folder)).distinct()


@query
def static_names(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).where("file_path is not null").select("file_path", evidence.static_name(F.col("file_path")).alias("static_name")).distinct()


@query
def vision_gate(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", wants_vision("auto", F.col("text"), F.col("embedded_image_count")).alias("wanted"))


@query
def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    from evigrain.sources.tables import audit_rows

    return audit_rows(ranked(spark, folder))


@query
def build_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The whole batch program over the pages."""
    return build(pages(spark, folder), DEFAULT_QUESTION).evidence


@query
def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the four packed fields, single ones too."""
    terms = small_rows(table(spark, folder, "canonical_term"))
    return split_packed(table(spark, folder, "sepsis_atlas_results"), "row_id", names=term_names(terms))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the fields that hold two or more."""
    return p5_values(spark, folder).where("n_items >= 2").drop("n_items").distinct()
