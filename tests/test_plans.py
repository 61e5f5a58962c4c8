"""Reading of tables, the entry file, and the queries on tables of odd rows."""

import importlib
import sys
from pathlib import Path

import pytest

from evigrain.plans import tables


def test_rows_delivered_again(spark, tmp_path, monkeypatch):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 1), (None, "x", 1), (None, "x", 1), ("b", None, 1), ("b", None, 3), ("c", "z", 1)]
    spark.createDataFrame(rows, "id string, text string, n int").repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    want = sorted({(r[0], r[1]) for r in rows}, key=str)
    got = lambda: sorted(((r.id, r.text) for r in tables.delivered_once(spark, str(tmp_path), "t", "id", "text").collect()), key=str)
    assert got() == want
    monkeypatch.setattr(tables, "MOST_COPIES", 0)  # the same by a join in a shuffle
    assert got() == want
    spark.createDataFrame([], "id string, text string").write.parquet(f"{tmp_path}/e.parquet")
    assert tables.delivered_once(spark, str(tmp_path), "e", "id", "text").count() == 0


def test_small_tables_are_checked(spark):
    df = spark.range(5)
    assert len(tables.small_rows(df, 5)) == 5
    with pytest.raises(ValueError):
        tables.small_rows(df, 4)


def test_every_query_has_columns_of_its_sql():
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 36
