"""Evidence tables as CSV, audit trails as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.lexicon import NA_TOKENS
from evigrain.operators.provenance import source_link
from evigrain.schemas import AUDIT, EVIDENCE_COLUMNS

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """A CSV evidence table of any set of columns, all strings but the relevance; tokens for absent values become null."""
    rows = spark.read.options(**_CSV, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    known = rows.select(*(F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in rows.columns))
    return known.withColumn("query_relevance_score", F.col("query_relevance_score").try_cast("double")) if "query_relevance_score" in known.columns else known


def write_evidence(table: DataFrame, path: str, files: int | None = 1, canonical: bool = True) -> None:
    """CSV with doubled quotes; one file by default, None keeps the partitions of a large table."""
    table = table.select(*EVIDENCE_COLUMNS) if canonical else table.drop("_relevance")
    (table if files is None else table.coalesce(files)).write.mode("overwrite").options(**_CSV, emptyValue="").csv(path)


def audit_rows(ranked: DataFrame) -> DataFrame:
    """The audit record of every retrieved passage, by file, best first."""
    page = F.col("page_number").cast("string")
    rows = ranked.select("source_file", F.col("page_number").alias("source_page"), F.col("passage_id").alias("source_passage_id"), source_link(F.col("source_path"), page).alias("source_link"), "score", "text", "rank")
    return rows.orderBy("source_file", "rank").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT.fields))


def write_audit(ranked: DataFrame, path: str) -> None:
    audit_rows(ranked).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType(AUDIT.fields)).json(path)


def show_summary(table: DataFrame) -> None:
    table.select("study_name", "predictor", "outcome", "effect_size", "performance", "support_status").show(truncate=False)
