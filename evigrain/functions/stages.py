"""Stages of dear expressions that the optimizer must not merge.

A column used many times by the next stage would be copied into each use when projections are collapsed, and
so again by the stage after it: the plan grows exponentially.  A generator over an array of one struct is a
barrier to that; it adds no shuffle and yields exactly one row per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns added or replaced, worked out once."""
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*kept, F.explode(F.array(made)).alias("_made")).select(*kept, *(F.col(f"_made.{n}").alias(n) for n in columns))
