"""Queries of the operators on training data: (spark, folder) -> DataFrame, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.boilerplate import repeated_lines, without_lines
from evigrain.llm.mapping import map_fields
from evigrain.llm.mixing import mix
from evigrain.llm.packing import pack
from evigrain.llm.pieces import oversized_pieces, split_oversized
from evigrain.llm.scans import count_parts, find_noise, repair_texts, titles_of
from evigrain.llm.sentences import learn, split_sentences
from evigrain.llm.tokens import with_tokens
from evigrain.llm.toxicity import score_documents, toxic_rates
from evigrain.llm.truncation import find_truncated, truncation_rates
from evigrain.plans.tables import delivered_once, small_rows, table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entry of every predictor and outcome value."""
    mapped = map_fields(table(spark, folder, "sepsis_atlas_results"), table(spark, folder, "canonical_term"))
    return mapped.select("row_id", "field_name", "item_no", "term_id").distinct()


def _scanned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pages, records of both tables) with the columns the scan operators take."""
    pages = table(spark, folder, "page_document")
    kept = pages.select(F.lit("page_document").alias("table_name"), F.col("page_id").alias("record_id"), F.col("file_name").alias("file"), F.col("page_number").alias("page"), "text")
    passages = table(spark, folder, "passage").select(F.lit("passage").alias("table_name"), F.col("passage_id").alias("record_id"), F.col("source_file").alias("file"), F.col("page_number").alias("page"), "text")
    return pages, kept.unionByName(passages)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of scan damage in every page and passage."""
    pages, records = _scanned(spark, folder)
    found = find_noise(spark, records, count_parts(pages.select("text")), titles_of(pages))
    # A page has every kind its passages have, wherever in the page their edges fall.
    own, page = F.struct("table_name", "record_id"), F.struct(F.lit("page_document").alias("table_name"), F.regexp_replace("record_id", r":c\d+$", "").alias("record_id"))
    both = found.select(F.explode(F.when(F.col("table_name") == "passage", F.array(own, page)).otherwise(F.array(own))).alias("r"), "noise_kind").select("r.*", "noise_kind")
    known = pages.select(F.col("page_id").alias("record_id"), F.lit(True).alias("known")).distinct()
    return both.distinct().join(known, "record_id", "left").where((F.col("table_name") == "passage") | F.col("known")).select("table_name", "record_id", "noise_kind")


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every page and passage as continuous paragraphs."""
    pages = table(spark, folder, "page_document")
    columns = {"page_document": ("page_id", "file_name", "page_number", "text"), "passage": ("passage_id", "source_file", "page_number", "text")}
    once = [delivered_once(spark, folder, t, *c).select(F.lit(t).alias("table_name"), *(F.col(x).alias(y) for x, y in zip(c, ("record_id", "file", "page", "text")))) for t, c in columns.items()]
    return repair_texts(spark, once[0].unionByName(once[1]), count_parts(pages.select("text")), titles_of(pages))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every page and passage within the limit, oversized ones in overlapping pieces."""
    parts = [split_oversized(delivered_once(spark, folder, t, k, "text"), k).withColumnRenamed(k, "record_id").select(F.lit(t).alias("table_name"), "*") for t, k in (("page_document", "page_id"), ("passage", "passage_id"))]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of both tables that had to be cut."""
    parts = [oversized_pieces(table(spark, folder, t), k).where("piece_no = 2").select(F.lit(t).alias("table_name"), F.col(k).alias("record_id")) for t, k in (("page_document", "page_id"), ("passage", "passage_id"))]
    return parts[0].unionByName(parts[1]).distinct()


def p4_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage as its sentences."""
    return split_sentences(delivered_once(spark, folder, "passage", "passage_id", "text"), learn(table(spark, folder, "passage").select("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence ends of the passages without a line break, under a model learnt from all passages."""
    passages = table(spark, folder, "passage")
    plain = passages.where(~F.contains("text", F.lit("\n")) & (F.btrim("text") != ""))
    return split_sentences(plain, learn(passages.select("text"))).select("passage_id", "sentence_no", "end_char").distinct()


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """What operator 6 judges, each row once: a copy would be evidence for its own end."""
    return find_truncated(spark, delivered_once(spark, folder, "sepsis_atlas_results", "row_id", "source_file", "source_anchor", "outcome", "field_sources_json"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that were cut off."""
    return _values(spark, folder).where("cut").select("row_id", "field_name").distinct()


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts values off."""
    return truncation_rates(_values(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line repeated excessively within its source file."""
    return repeated_lines(table(spark, folder, "passage")).select("passage_id", "line_no").distinct()


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage without those lines."""
    passages = delivered_once(spark, folder, "passage", "passage_id", "source_file", "text")
    return without_lines(passages, repeated_lines(passages)).select("passage_id", "source_file", "text", "lines_removed")


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of each capacity, and in containers of all capacities jointly (spec_name mixed)."""
    specs = {r.spec_name: [r.capacity_tokens] for r in small_rows(table(spark, folder, "container_spec"))}
    sized = with_tokens(table(spark, folder, "documents")).persist()
    specs["mixed"] = [c for own in specs.values() for c in own]
    packed = [pack(spark, sized, own).select(F.lit(name).alias("spec_name"), "*") for name, own in sorted(specs.items())]
    return reduce(DataFrame.unionByName, packed)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each kind are."""
    bins = p8_pack(spark, folder).groupBy("spec_name", "container").agg(F.first("capacity").alias("capacity"), F.sum("n_tokens").alias("tokens"))
    return bins.groupBy("spec_name").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("filled"), F.count_if(F.col("tokens") > F.col("capacity")).alias("n_overfull"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    return mix(spark, docs, with_tokens(docs), table(spark, folder, "mix_target"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, with the number of uses."""
    return _mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source reaches."""
    return _mixture(spark, folder)[1]


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document."""
    return score_documents(spark, table(spark, folder, "documents"), table(spark, folder, "doc_label"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with offending content."""
    return p10_scores(spark, folder).where("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of offending documents per source."""
    return toxic_rates(p10_scores(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sentences": p4_sentences,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
_KEY = r"regexp_replace(regexp_replace(lower(line), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g'), '\p{Nd}+', '0', 'g')"
ORACLE: dict[str, str] = {
    "p2_found": "SELECT DISTINCT 'page_document' AS table_name, page_id AS record_id FROM page_document WHERE length(text) > 2400 UNION ALL SELECT DISTINCT 'passage', passage_id FROM passage WHERE length(text) > 2400",
    "p7_found": f"""WITH p AS (SELECT DISTINCT passage_id, source_file, text FROM passage), l AS (SELECT passage_id, source_file, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line_no FROM p WHERE text IS NOT NULL),
      k AS (SELECT *, {_KEY} AS key FROM l), n AS (SELECT source_file, count(DISTINCT passage_id) AS docs FROM p GROUP BY source_file), c AS (SELECT source_file, key, count(DISTINCT passage_id) AS seen FROM k GROUP BY source_file, key)
      SELECT DISTINCT passage_id, line_no FROM k JOIN c ON k.source_file IS NOT DISTINCT FROM c.source_file AND k.key = c.key JOIN n ON k.source_file IS NOT DISTINCT FROM n.source_file WHERE seen >= 8 AND seen >= 0.1 * docs AND regexp_matches(line, '\\p{{L}}')""",
}
