"""Fixed schemas of the data model, and the sentinels of the evidence table."""

from pyspark.sql import types as T

MISSING, NOT_INDEXED, LEGACY = "Not reported", "Not indexed", "Legacy CSV"

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PAGE = _struct(file_name=_S, file_path=_S, page_number=_I, page_label=_S, total_pages=_I, title=_S, embedded_image_count=_I, source_types=_S, vision_mode=_S, vision_model=_S, text=_S)
PASSAGE = _struct(passage_id=_S, source_file=_S, source_path=_S, page_number=_I, chunk_index=_I, text=_S, score=_D)
AUDIT = _struct(source_file=_S, source_page=_I, source_passage_id=_S, source_link=_S, score=_D, text=_S)
# The columns of the evidence table, in order.
EVIDENCE_COLUMNS = [
    "study_name", "population", "sample_size", "predictor", "outcome", "timing", "method", "effect_size",
    "performance", "notes", "source_file", "source_page", "source_passage_id", "source_link", "source_anchor",
    "field_sources_json", "support_status", "support_notes", "query", "query_relevance_score",
]
EVIDENCE = T.StructType([T.StructField(c, _D if c == "query_relevance_score" else _S) for c in EVIDENCE_COLUMNS])
# Columns shown in a result table, and fields that carry a source.
VISIBLE_COLUMNS = [
    "study_name", "population", "sample_size", "predictor", "outcome", "timing", "method", "effect_size",
    "performance", "source_link", "source_file", "source_page", "support_status",
]
SOURCE_FIELDS = [
    "population", "sample_size", "predictor", "outcome", "timing", "method", "effect_size", "performance",
]
CHECKED_FIELDS = SOURCE_FIELDS[1:]
EXTRACTED_FIELDS = ["study_name", *SOURCE_FIELDS, "notes", "source_file", "source_page", "source_passage_id", "source_anchor"]
