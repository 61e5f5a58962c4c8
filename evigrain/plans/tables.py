"""Reading the tables of a data folder; fixed tables are checked for size before they leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 20_000
MOST_COPIES = 500_000  # places of rows delivered again that may be broadcast, some 50 bytes each


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delivered_once(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """These columns of a table, of equal rows the first as stored; the first column is the record's key.

    Only the key, a hash of the row and its place in the files are shuffled, never a text.  The places of later
    copies are few: they are broadcast up to a checked number, and joined in a shuffle beyond it.
    """
    rows = table(spark, folder, name)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    placed = rows.select(*columns, *place)
    at = placed.select(F.col(columns[0]).alias("_key"), F.xxhash64(*columns).alias("_hash"), F.struct("_file", "_row").alias("_place"))
    first = at.groupBy("_key", "_hash").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a._hash") == F.col("b._hash"))
    later = at.alias("a").join(first.alias("b"), same).where("a._place <> b._first").select("a._place._file", "a._place._row").persist()
    few = later.count() <= MOST_COPIES
    return placed.join(F.broadcast(later) if few else later, ["_file", "_row"], "left_anti").drop("_file", "_row")


def small_rows(df: DataFrame, most: int = SMALL_TABLE_ROWS) -> list[Row]:
    """All rows of a table that is small by contract (a term list, a set of targets); more than `most` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"expected at most {most} rows in a small table")
    return rows


def term_names(rows: list[Row]) -> list[str]:
    """Every name and alias of a term list."""
    return [n for r in rows for n in (r.term_name, *(r.aliases or "").split("|")) if n]
