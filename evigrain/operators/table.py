"""Operators on the evidence table: repair, order, question, facets, metrics, source review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions.stages import settled
from evigrain.functions.text import trimmed
from evigrain.operators.provenance import page_of, with_pdf
from evigrain.operators.scoring import expand, row_relevance
from evigrain.operators.validate import sources_map, with_support
from evigrain.schemas import EVIDENCE_COLUMNS, LEGACY, MISSING, NOT_INDEXED, SOURCE_FIELDS, VISIBLE_COLUMNS

TIES = ("source_file", "source_passage_id", "source_anchor", "effect_size", "performance")


def repair(table: DataFrame, files: DataFrame | None = None, folder: str = "articles") -> DataFrame:
    """A table of any age in today's form: columns completed, links and field sources made, rows without a status validated.

    Of source_file, source_page and source_passage_id each column that holds nothing but the sentinel (a null cell
    is not one) is filled anew, the first from study_name.  files: paths of the files that exist; a row whose file is
    among them links to its published copy, another keeps a link to the web and has none otherwise.
    """
    rows = table.withColumns({c: F.lit(MISSING) for c in EVIDENCE_COLUMNS if c not in table.columns})
    anew = {"source_file": F.col("study_name"), "source_page": F.lit(NOT_INDEXED), "source_passage_id": F.lit(LEGACY)}
    empty = rows.agg(*(F.coalesce(F.bool_and(F.coalesce(F.col(c) == MISSING, F.lit(False))), F.lit(False)).alias(f"_no_{c}") for c in anew))
    rows = rows.crossJoin(F.broadcast(empty))  # one row on that side
    rows = rows.withColumns({c: F.when(F.col(f"_no_{c}"), new).otherwise(F.col(c).cast("string")) for c, new in anew.items()}).drop(*(f"_no_{c}" for c in anew))
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in EVIDENCE_COLUMNS[:-1]})
    filled = with_pdf(filled, files, folder) if files is not None else filled.withColumn("pdf_path", F.lit(None).cast("string"))
    kept = F.when((F.col("source_link") != "") & ~F.startswith("source_link", F.lit("file://")), F.col("source_link")).otherwise(MISSING)
    filled = settled(filled, {"source_link": F.coalesce(published_link(F.col("pdf_path"), F.col("source_page")), kept)})
    anchor = trimmed(F.col("source_anchor"))
    own = F.map_from_entries(F.array_compact(F.array(*(F.when(~trimmed(F.col(f)).isin("", MISSING), F.struct(F.lit(f).alias("key"), anchor.alias("value"))) for f in SOURCE_FIELDS))))
    filled = filled.withColumn("field_sources_json", F.when(F.col("field_sources_json").isin("", MISSING) & (anchor != ""), F.to_json(own)).otherwise(F.col("field_sources_json")))
    again = F.col("support_status").isin("", MISSING, "legacy anchor")
    before = filled.withColumns({"_status": F.col("support_status"), "_notes": F.col("support_notes"), "_again": again})
    checked = with_support(before)
    return checked.withColumns({"support_status": F.when(F.col("_again"), F.col("support_status")).otherwise(F.col("_status")), "support_notes": F.when(F.col("_again"), F.col("support_notes")).otherwise(F.col("_notes"))}).drop("_status", "_notes", "_again", "pdf_path")


def in_order(table: DataFrame) -> DataFrame:
    return table.orderBy("support_status", "study_name", "predictor", *TIES)


def relevant(table: DataFrame, question: str | None) -> DataFrame:
    """table with _relevance; rows of relevance 0 go, unless all have it or the question is blank.

    Whether any row is relevant is one aggregate with one row; each task looks no further than its first such row.
    """
    scored = table.withColumn("_relevance", row_relevance(expand(question)) if (question or "").strip() else F.lit(0.0))
    if (question or "").strip():
        some = scored.where("_relevance > 0").select(F.lit(1).alias("one")).limit(1).agg(F.count("*").alias("_some"))
        scored = scored.crossJoin(F.broadcast(some)).where((F.col("_relevance") > 0) | (F.col("_some") == 0)).drop("_some")
    return scored


def in_rank(table: DataFrame) -> DataFrame:
    """Relevant rows, best first."""
    return table.orderBy(F.desc("_relevance"), "support_status", "study_name", "predictor", *TIES)


def rank(table: DataFrame, question: str | None) -> DataFrame:
    return in_rank(relevant(table, question))


def facet_options(table: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("string")
    return table.where(F.coalesce((F.btrim(value) != "") & (value != MISSING), F.lit(False))).select(value.alias("value")).distinct().orderBy("value")


def facet_filter(table: DataFrame, **chosen: Sequence[str]) -> DataFrame:
    """Rows whose columns hold one of the chosen values; an empty choice is no filter."""
    for column, values in chosen.items():
        if values:
            table = table.where(F.col(column).isin(list(values)))
    return table


def sidebar_metrics(table: DataFrame) -> DataFrame:
    """(n_rows, n_studies, n_supported); a status that contains the word counts, "unsupported" too."""
    return table.agg(F.count("*").alias("n_rows"), F.count_distinct("study_name").alias("n_studies"), F.count_if(F.contains(F.lower("support_status"), F.lit("supported"))).alias("n_supported"))


def result_metrics(ranked: DataFrame) -> DataFrame:
    """(n_rows, n_studies, n_missing, mean_relevance) of a result."""
    missing = sum((F.when(F.col(c) == MISSING, 1).otherwise(0) for c in VISIBLE_COLUMNS), F.lit(0))
    return ranked.agg(F.count("*").alias("n_rows"), F.count_distinct("study_name").alias("n_studies"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"), F.coalesce(F.bround(F.avg("_relevance"), 2), F.lit(0.0)).alias("mean_relevance"))


def result_table(ranked: DataFrame) -> DataFrame:
    return ranked.select(*VISIBLE_COLUMNS, F.col("_relevance").alias("query_relevance"))


def source_review(ranked: DataFrame, limit: int | None = 12) -> DataFrame:
    """The first row of each source in rank order, the best `limit` of them (None: all)."""
    key = F.concat_ws("|", "source_passage_id", "source_file", "source_page", F.substring("source_anchor", 1, 300))
    order = [F.desc("_relevance"), "support_status", "study_name", "predictor", *TIES]
    first = ranked.withColumn("source_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("source_key").orderBy(*order))).where("_n = 1").drop("_n")
    return first.orderBy(*order).limit(limit) if limit is not None else first


def source_groups(table: DataFrame, key: str) -> DataFrame:
    """(key, place, source, fields): the quotes of each row with the fields that share them, first seen first."""
    each = table.select(key, F.posexplode(F.map_entries(sources_map(F.col("field_sources_json")))).alias("pos", "e")).select(key, "pos", F.col("e.key").alias("field"), F.col("e.value").alias("source")).where(F.coalesce(F.col("source") != "", F.lit(False)))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda s: s["field"]), ", ")
    return each.groupBy(key, "source").agg(F.min("pos").alias("place"), ordered.alias("fields"))


def card(ranked: DataFrame) -> DataFrame:
    """What a source card shows: title, link, escaped quote, notes."""
    escaped = F.col("source_anchor")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    return ranked.select(F.concat_ws(" | ", "study_name", "source_file", F.concat(F.lit("page "), "source_page")).alias("title"), "source_link", escaped.alias("quote_html"), "support_status", "support_notes")


def static_name(path: Column) -> Column:
    """A file-system safe name for a source file: its stem, a digest of its path, its suffix."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    suffix = F.regexp_extract(name, r"(?<=[^.])\.[^.]+$", 0)
    stem = F.when(suffix != "", F.substr(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)
    safe = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}._-]", "_"), 1, 90)
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("source")), F.lit("-"), F.substring(F.sha1(path), 1, 12), F.when(F.lower(suffix) == ".pdf", suffix).otherwise(".pdf"))


def published_link(path: Column, page: Column, prefix: str = "/app/static/source_pdfs") -> Column:
    """A link to a published copy; page 0 keeps its fragment here."""
    number = page_of(page)
    return F.concat(F.lit(prefix + "/"), F.replace(F.url_encode(static_name(path)), F.lit("+"), F.lit("%20")), F.coalesce(F.concat(F.lit("#page="), number), F.lit("")))
