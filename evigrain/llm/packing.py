"""Filling fixed-capacity containers with items.

What is planned is not items but sizes: the histogram of sizes has at most one entry per token of capacity,
however many items there are.  On it a best-fit-decreasing plan is made for whole groups of equal bins at
once: each size goes where it leaves the least room; where it fits nowhere, bins of the permitted size that
wastes least are opened; in the end every bin shrinks to the smallest permitted size that holds its contents.
The plan is a table of intervals, "items k..l of size s go to bins b..", and every item finds its bin by its
number among the items of its size, counted in salted groups, so that no size and no bin gathers in one task.

Defined results: an item larger than the largest capacity is split into full pieces and a rest; no other item
is ever split; an item of size 0 needs no container and gives no row; null sizes count as 0.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 200_000  # items of one size that are numbered in one group


@dataclass
class Plan:
    """Placements (size, first item, items, first bin) and bins (first bin, bins, used, capacity) as sorted arrays."""

    places: np.ndarray
    bins: np.ndarray

    def bin_of(self, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.places[:, 0] * (1 << 40) + self.places[:, 1], size * (1 << 40) + number, side="right") - 1
        return self.places[at, 3] + number - self.places[at, 1]

    def capacity_of(self, number: np.ndarray) -> np.ndarray:
        return self.bins[np.searchsorted(self.bins[:, 0], number, side="right") - 1, 3]


def plan_bins(histogram: dict[int, int], capacities: Sequence[int]) -> Plan:
    """Variable-capacity best fit over a histogram of sizes, none above the largest capacity."""
    permitted = sorted(set(capacities))
    places: list[tuple[int, int, int, int]] = []
    done: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room left -> groups (first bin, bins, capacity)
    free: list[int] = []
    opened = 0

    def keep(room: int, group: tuple[int, int, int]) -> None:
        if room == 0:
            done.append((group[0], group[1], group[2], group[2]))
            return
        if room not in rooms:
            rooms[room] = []
            insort(free, room)
        rooms[room].append(group)

    for size in sorted(histogram, reverse=True):
        left, number = histogram[size], 0
        while left:
            at = bisect_left(free, size)
            if at < len(free):
                room = free[at]
                first, count, capacity = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], free[at]
                used = min(count, left)
                if used < count:
                    keep(room, (first + used, count - used, capacity))
            else:
                # The size that wastes least of itself when filled with such items; the larger of equals has more room for the smaller ones to come.
                capacity = min((c for c in permitted if c >= size), key=lambda c: ((c % size) / c, -c))
                room, first, used = capacity, opened, -(-left // (capacity // size))
                opened += used
            places.append((size, number, used, first))
            keep(room - size, (first, used, capacity))
            number += used
            left -= used
    for room, groups in rooms.items():
        for first, count, capacity in groups:
            used = capacity - room
            done.append((first, count, used, next(c for c in permitted if c >= used)))
    as_array = lambda rows: np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(as_array(places), as_array(done))


def pieces_of(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start_token, n_tokens): items above the capacity in full pieces and a rest."""
    whole = F.coalesce(F.col(size).cast("long"), F.lit(0))
    parts = F.expr(f"sequence(0L, (coalesce(cast(`{size}` as bigint), 0L) - 1) div {capacity})")
    return items.where(whole > 0).select(key, whole.alias("_all"), F.explode(parts).alias("_p")).select(key, (F.col("_p") + 1).cast("int").alias("piece_no"), (F.col("_p") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("_p") * capacity).alias("n_tokens"))


def numbered(pieces: DataFrame, key: str, histogram: dict[int, int], rows: int = ROWS) -> DataFrame:
    """pieces with `number`, from 0 among the pieces of one size, counted per size and salt; a size has as many salts as its number of pieces asks for."""
    many = {size: -(-n // rows) for size, n in histogram.items() if n > rows}
    salts = F.coalesce(F.create_map(*[F.lit(x) for pair in many.items() for x in pair])[F.col("n_tokens")], F.lit(1)) if many else F.lit(1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), salts))
    sums = salted.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_salt")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece_no")) - 1
    return salted.withColumn("_own", own).join(before, ["n_tokens", "_salt"]).withColumn("number", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before")


def pack(spark: SparkSession, items: DataFrame, capacities: Sequence[int], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(container, capacity, key, piece_no, start_token, n_tokens) for containers of the permitted capacities."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    pieces = pieces_of(items, key, size, max(capacities))
    histogram = {r.n_tokens: r.n for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # one row per size: at most the largest capacity
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacities))
    placed = numbered(pieces, key, histogram)
    names = ["container", "capacity", key, "piece_no", "start_token", "n_tokens"]
    key_type = items.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            sizes, numbers = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n_tokens", "number"))
            if len(sizes):
                bins = p.bin_of(sizes, numbers)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(p.capacity_of(bins).astype(np.int32)), batch.column(key), batch.column("piece_no"), batch.column("start_token"), batch.column("n_tokens")], names=names)

    return placed.mapInArrow(place, f"container long, capacity int, `{key}` {key_type}, piece_no int, start_token long, n_tokens long")
