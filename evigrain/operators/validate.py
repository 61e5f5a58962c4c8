"""How well an evidence row is supported by the text it quotes, and its normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrain.functions.stages import settled
from evigrain.functions.text import array_of, collapsed, tokens
from evigrain.lexicon import GENERIC_WORDS, STOPWORDS
from evigrain.operators.provenance import anchor_passage, best_anchor, field_sources, source_link
from evigrain.operators.retrieve import joined_text
from evigrain.schemas import CHECKED_FIELDS, EVIDENCE_COLUMNS, MISSING

_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def sources_map(json: Column) -> Column:
    """field_sources_json as a map; what is no JSON object is an empty map."""
    return F.coalesce(F.from_json(json, "map<string,string>", _JSON), F.create_map().cast("map<string,string>"))


def field_supported(value: Column, anchor: Column) -> Column:
    """Whether any number of the value, or enough of its words, stand in the anchor."""
    numbers = F.regexp_extract_all(value, F.lit(r"(?U)(\d+(?:\.\d+)?)"), 1)
    words = F.array_distinct(F.slice(F.filter(tokens(value), lambda w: (F.length(w) > 2) & ~F.array_contains(array_of([*STOPWORDS, *GENERIC_WORDS]), w)), 1, 8))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(anchor), w)))
    return F.exists(numbers, lambda n: F.contains(anchor, n)) | (hits >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(words))))


def with_support(rows: DataFrame) -> DataFrame:
    """rows with support_status and support_notes."""
    anchor = collapsed(F.col("source_anchor"))
    prepared = settled(rows, {"_anchor": anchor, "_sources": sources_map(F.col("field_sources_json"))})
    # Each field is judged once, in a projection of its own: 1 supported, 0 weak, null not reported.
    judged = []
    for f in CHECKED_FIELDS:
        value, own = collapsed(F.col(f)), collapsed(F.coalesce(F.nullif(F.col("_sources")[f], F.lit("")), F.col("_anchor")))
        judged.append(F.when((value != "") & (value != MISSING), field_supported(value, own)).alias(f))
    prepared = settled(prepared, {"_ok": F.struct(*judged)})
    count = lambda test: sum((F.when(test(F.col("_ok")[f]), 1).otherwise(0) for f in CHECKED_FIELDS), F.lit(0))
    prepared = settled(prepared, {"_checked": count(lambda c: c.isNotNull()), "_good": count(lambda c: c)})
    weak = F.array_join(F.array_compact(F.array(*(F.when(~F.col("_ok")[f], F.lit(f)) for f in CHECKED_FIELDS))), ", ")
    none = (F.col("_anchor") == "") | (F.col("_anchor") == MISSING)
    status = F.when(none, "unsupported").when(F.col("_checked") == 0, "needs review").when(F.col("_good") == F.col("_checked"), "supported").when(F.col("_good") > 0, "partial").otherwise("needs review")
    # The notes of each status.
    notes = (
        F.when(none, "No source anchor was extracted.")
        .when(F.col("_checked") == 0, "Only missing values were extracted.")
        .when(F.col("_good") == F.col("_checked"), "All reported fields have lexical support in the source anchor.")
        .when(F.col("_good") > 0, F.concat(F.lit("Review fields: "), weak, F.lit(".")))
        .otherwise("Reported fields were not found lexically in the source anchor.")
    )
    return prepared.withColumns({"support_status": status, "support_notes": notes}).drop("_anchor", "_sources", "_ok", "_checked", "_good")


def normalise_rows(rows: DataFrame, question: str) -> DataFrame:
    """Extracted rows with their study's `passages` as rows of the evidence table.

    Absent columns are completed; values equal to the sentinel are filled from the anchor's passage, a null is
    not and becomes the sentinel at the end.
    """
    absent = {c: F.lit(MISSING) for c in EVIDENCE_COLUMNS if c not in rows.columns}
    rows = settled(rows, absent | {"_text": joined_text(F.col("passages"), " "), "query": F.lit(question)})
    stem = F.regexp_replace(F.col("passages")[0]["source_file"], r"(?<=[^/])\.[^./]*$", "")
    rows = rows.withColumn("study_name", collapsed(F.coalesce(F.nullif(F.col("study_name"), F.lit("")), stem)))
    own = collapsed(F.col("source_anchor"))
    rows = settled(rows, {"source_anchor": F.when((own != "") & (own != MISSING), own).otherwise(F.coalesce(best_anchor(F.col("_text"), *(F.col(c) for c in ("predictor", "outcome", "effect_size", "performance"))), F.lit("")))})
    rows = settled(rows, {"_from": anchor_passage(F.col("source_anchor"), F.col("passages"))})
    given = lambda c, other: F.when(F.col(c) == MISSING, other).otherwise(F.col(c))
    rows = settled(rows, {"source_file": given("source_file", F.col("_from.source_file")), "source_page": given("source_page", F.coalesce(F.col("_from.page_number").cast("string"), F.lit(MISSING))), "source_passage_id": given("source_passage_id", F.col("_from.passage_id"))})
    blank = lambda c: F.coalesce(F.col(c).isin("", MISSING), F.lit(True))
    link = source_link(F.col("_from.source_path"), F.coalesce(F.col("source_page"), F.col("_from.page_number").cast("string")))
    json = F.to_json(field_sources(F.col("_text"), F.col("source_anchor"), {f: F.col(f) for f in ("population", *CHECKED_FIELDS)}))
    rows = settled(rows, {"source_link": F.when(blank("source_link"), link).otherwise(F.col("source_link")), "field_sources_json": F.when(blank("field_sources_json"), json).otherwise(F.col("field_sources_json"))})
    rows = with_support(rows).withColumn("query_relevance_score", F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0)))
    return to_evidence(rows)


def to_evidence(rows: DataFrame) -> DataFrame:
    """The columns of the evidence table in order, null and empty as the sentinel."""
    text = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING)).alias(c) for c in EVIDENCE_COLUMNS[:-1]]
    return rows.select(*text, F.col("query_relevance_score").cast("double").alias("query_relevance_score"))
