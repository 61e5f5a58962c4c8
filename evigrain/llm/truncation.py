"""Text cut off by field limits.

A backward character n-gram model: for the last k characters of a value (k up to seven, digits as one sign)
it weighs how often texts of that column end after them against how often they go on.  Longer contexts fall
back on shorter ones, and a value never counts as evidence for itself.  A length that one column reaches far
more often than the lengths around it (a field limit) adds the logarithm of that excess as evidence.

Every value is also cut at a place of its own text, chosen by hash, and the remainder judged by the same model:
that shows how log-odds are distributed where a text does go on.  For each language and column the threshold is
the bottom of the valley between those and the values as they stand; groups with few values lean on their column.  What a cutting program leaves behind (an ellipsis, half an entity) and JSON whose structure is
not closed are cut without a model; a JSON value is also cut if a text quoted in it is.

The model is a fixed number of counters (`ORDERS` x 2**`BITS`), whatever the size of the corpus.

Defined results: null, blank and missing-marked values are never cut; a value delivered again counts once; a
value whose end resembles nothing seen elsewhere (a slip of the pen) is not called cut.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.mapping import MISSING_MARKS
from evigrain.llm.sentences import languages

ORDERS, BITS = 7, 21
PRIOR = 20.0  # weight of the shorter context's estimate in places
LEAN = 300.0  # weight of a column's distribution in that of one of its languages, in values
LOW, HIGH, STEP = -12.0, 4.0, 0.125  # histogram of log-odds
MOST_LENGTHS = 100_000
CUT_MARK = re.compile(r"(?:�+|\s*\[tr\w*\]?|\s*\[\.\.\.\]?|&\w{0,7};?|\s*\(cont\w*|(?<=[^\s….\u3040-\u9fff])(?:…|\.\.\.))$")  # what a cutting program leaves; dots set off by a blank are the writer's own
ENDS = ".!?。！？।؟)）»”"  # fixed values: signs that close a text
_STRINGS = re.compile(r'"((?:[^"\\]|\\.)*)"\s*(:?)', re.S)
_COLUMN_SEED = 1000003


def parts_of_value(field: str, text: str, is_json: bool) -> tuple[bool, list[str]]:
    """(structure cut, texts to judge) of a value; a JSON value is judged by the texts quoted in it."""
    if not is_json:
        return False, [text.rstrip()]
    bare = text.strip().rstrip(",; \n")
    if not bare.startswith(("{", "[")):
        return False, []
    if not bare.endswith(("}", "]")):
        return True, []
    try:
        loaded = json.loads(bare)
        values = list(loaded.values()) if isinstance(loaded, dict) else loaded if isinstance(loaded, list) else []
        return False, [v.rstrip() for v in values if isinstance(v, str) and v.strip()]
    except ValueError:
        pass
    try:
        loaded = ast.literal_eval(bare)
        if isinstance(loaded, dict):
            return False, [v.rstrip() for v in loaded.values() if isinstance(v, str) and v.strip()]
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        pass
    found = [_unescape(m[1]).rstrip() for m in _STRINGS.finditer(bare) if not m[2]]
    return False, [v for v in found if v]


def _unescape(text: str) -> str:
    try:
        return json.loads(f'"{text}"')
    except ValueError:
        return text


_SEED, _TURN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: str) -> np.ndarray:
    """Small letters as numbers, digits as one sign; the separator \\0 is 0."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code >= 48) & (code <= 57), np.uint32(48), code).astype(np.uint64)


def start_hash(n: int, column: int) -> np.ndarray:
    return np.full(n, np.uint64(column * _COLUMN_SEED + 1))


def longer(rolled: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """The hash of contexts with one more character before them, the k-th from the end."""
    rolled = (rolled ^ (code * _TURN + np.uint64(k))) * _SEED
    return rolled ^ (rolled >> np.uint64(29))


def bucket(rolled: np.ndarray) -> np.ndarray:
    return (rolled >> np.uint64(64 - BITS)).astype(np.int64)


def tail_buckets(tails: list[str], column: int) -> np.ndarray:
    """(orders, tails): the counter of the last k characters of each text, -1 where it is shorter."""
    grid = codes_of("".join(t.lower()[-ORDERS:].rjust(ORDERS, "\0") for t in tails)).reshape(len(tails), ORDERS)
    rolled, out = start_hash(len(tails), column), np.full((ORDERS, len(tails)), -1, np.int64)
    for k in range(ORDERS):
        code = grid[:, ORDERS - 1 - k]
        rolled = longer(rolled, code, k)
        out[k] = np.where(code > 0, bucket(rolled), -1)
    return out


def _batches(batch: pa.RecordBatch, fields: list[str], json_fields: set[str]) -> Iterator[tuple[int, list[int], list[bool], list[str]]]:
    """(column number, rows, whether the structure is cut, texts) for each field of a batch."""
    for f, field in enumerate(fields):
        rows, cut, texts = [], [], []
        for i, value in enumerate(batch.column(f + 2).to_pylist()):
            if value is None or value.strip().lower() in MISSING_MARKS:
                continue
            structure, parts = parts_of_value(field, value, field in json_fields)
            if structure:
                rows.append(i)
                cut.append(True)
                texts.append("")
            for part in parts:
                rows.append(i)
                cut.append(False)
                texts.append(part)
        yield f, rows, cut, texts


class EndModel:
    """Counters of ends and continuations by context."""

    def __init__(self, ends: np.ndarray, goes: np.ndarray):
        self.ends, self.goes = ends, goes

    def odds(self, tails: list[str], column: int, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of an end, longest context with evidence) after each text; its own end, or (inside) its own continuation, is left out.

        After a word and a sign that closes a text the odds are those of its last three characters at least: long
        contexts of a sentence's end are rare ones.
        """
        p, reach = np.full(len(tails), 0.02), np.zeros(len(tails), int)
        for k, h in enumerate(tail_buckets(tails, column)):
            e, g = np.maximum(self.ends[k, h] - (not inside), 0), np.maximum(self.goes[k, h] - inside, 0)
            live = h >= 0
            reach = np.where(live & (e + g >= 3), k + 1, reach)
            p = np.where(live, (e + PRIOR * p) / (e + g + PRIOR), p)
            if k == 2:
                short = p
        p = np.where([t[-1:] in ENDS and t[-2:-1].isalpha() for t in tails], np.maximum(p, short), p)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p)), reach


def learn_ends(spark: SparkSession, rows: DataFrame, fields: list[str], json_fields: set[str]) -> EndModel:
    """Counts over all values: first where texts end, then how often those same contexts go on."""

    def count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros(ORDERS << BITS, np.int32)
        for batch in batches:
            for f, _, cut, texts in _batches(batch, fields, json_fields):
                seen = Counter(t[-ORDERS:] for t, c in zip(texts, cut) if not c and t)
                if seen:
                    n = np.array(list(seen.values()), np.int32)
                    for k, h in enumerate(tail_buckets(list(seen), f)):
                        np.add.at(ends, h[h >= 0] + (k << BITS), n[h >= 0])
        yield _sparse(ends)

    schema = "counter int, n long"
    ends = _dense(rows.mapInArrow(count_ends, schema))
    shared = spark.sparkContext.broadcast(np.packbits(ends > 0, axis=1))

    def count_goes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value, axis=1).astype(bool)
        goes = np.zeros((ORDERS, 1 << BITS), np.int64)
        for batch in batches:
            for f, _, cut, texts in _batches(batch, fields, json_fields):
                # Only a context that some text ends with counts, and it can only be one if the shorter context is.
                code = codes_of("\0".join(t.lower() for t, c in zip(texts, cut) if not c and t))
                at = np.flatnonzero(code[:-1] * code[1:] > 0)  # places with a character before and after them
                rolled = start_hash(len(at), f)
                for k in range(ORDERS):
                    own = code[at - k]
                    live = (own > 0) & (at >= k)
                    at, rolled = at[live], longer(rolled[live], own[live], k)
                    h = bucket(rolled)
                    live = wanted[k][h]
                    at, rolled = at[live], rolled[live]
                    goes[k] += np.bincount(h[live], minlength=1 << BITS)
        yield _sparse(np.minimum(goes, 2**31 - 1).astype(np.int32).ravel())

    goes = _dense(rows.mapInArrow(count_goes, schema))
    shared.unpersist()
    return EndModel(ends, goes)


def _sparse(counters: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counters)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counters[at].astype(np.int64))], names=["counter", "n"])


def _dense(counts: DataFrame) -> np.ndarray:
    """The counters of all tasks summed, as an array of fixed size; at most ORDERS x 2**BITS rows of eight bytes come to the driver."""
    out = np.zeros(ORDERS << BITS, np.int32)
    summed = counts.groupBy("counter").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    for chunk in summed.toArrow().to_batches():
        out[np.asarray(chunk.column(0))] = np.asarray(chunk.column(1))
    return out.reshape(ORDERS, 1 << BITS)


def field_limits(rows: DataFrame, fields: list[str]) -> dict[str, dict[int, float]]:
    """Lengths that a column reaches twenty times and ten times as often as the lengths around them, with the logarithm of that excess."""
    sizes = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.length(f).alias("size")) for f in fields))).alias("v")).select("v.*").where("size > 20")
    seen = sizes.groupBy("field", "size").count()
    near = seen.select("field", F.explode(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda d: F.col("size") + d)).alias("size"), (F.col("count") / 20).alias("near"))
    around = near.groupBy("field", "size").agg(F.sum("near").alias("near")).withColumn("near", F.greatest("near", F.lit(0.5)))
    # The own count stands in the sum once too.
    spikes = seen.where("count >= 20").join(around, ["field", "size"]).withColumn("near", F.greatest(F.col("near") - F.col("count") / 20, F.lit(0.5))).where("count >= 10 * near").limit(MOST_LENGTHS + 1).collect()
    if len(spikes) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} field limits")
    out: dict[str, dict[int, float]] = {f: {} for f in fields}
    for r in spikes:
        out[r.field][r.size] = math.log(r["count"] / r.near)
    return out


def threshold(stand: np.ndarray, goes_on: np.ndarray) -> float:
    """The log-odds at the bottom of the valley between texts that go on and values as they stand.

    Both are histograms; the valley is looked for between their medians, in the density smoothed over one unit
    on either side, and its middle is taken where it is flat.
    """
    if not stand.sum() or not goes_on.sum():
        return LOW
    low, high = (int(np.searchsorted(np.cumsum(h), h.sum() / 2)) for h in (goes_on, stand))
    if high - low < 2:
        return LOW
    width = int(1 / STEP)
    kernel = np.concatenate([np.arange(1, width + 1), np.arange(width - 1, 0, -1)]) / width
    dense = np.convolve(stand, kernel, mode="same")[low : high + 1]
    bottom = np.flatnonzero(dense <= dense.min() * (1 + 1e-9) + 1e-9)
    return float(LOW + STEP * (low + bottom[len(bottom) // 2] + 0.5))


def find_truncated(spark: SparkSession, df: DataFrame, key: str = "row_id", source: str = "source_file", fields: tuple[str, ...] = ("source_anchor", "outcome", "field_sources_json"), json_fields: tuple[str, ...] = ("field_sources_json",)) -> DataFrame:
    """(key, source, field_name, lang, odds, cut) for every value that is present; one row per record and field."""
    names, as_json = list(fields), set(json_fields)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), *(F.col(f).cast("string").alias(f) for f in names))
    model = learn_ends(spark, rows, names, as_json)
    limits = field_limits(rows, [f for f in names if f not in as_json])
    shared = spark.sparkContext.broadcast((model.ends, model.goes))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = EndModel(*shared.value)
        for batch in batches:
            keys, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for f, at, cut, texts in _batches(batch, names, as_json):
                sizes = pc.utf8_length(batch.column(f + 2)).to_pylist()
                own = limits.get(names[f], {})
                odds, reach = judge.odds([t[-ORDERS:] for t in texts], f)
                # The same text cut at a place of its own, after four characters at least and before its last two.
                places = [4 + xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % (len(t) - 5) if len(t) > 8 else 0 for t in texts]
                halves = [t[:p].rstrip() for t, p in zip(texts, places)]
                inner, seen = judge.odds([h[-ORDERS:] for h in halves], f, inside=True)
                inner = np.where(seen < 4, math.nan, inner)  # no evidence either way
                worst: dict[int, tuple[float, float, int]] = {}
                for j, (i, c, t) in enumerate(zip(at, cut, texts)):
                    o = -100.0 if c or CUT_MARK.search(t) else float(max(odds[j], 0.0) if reach[j] < 4 else odds[j])  # nothing like it was seen: no evidence of a continuation
                    if o > -100 and sizes[i] in own and t[-1] not in ENDS:
                        o -= own[sizes[i]]
                    if o < worst.get(i, (99.0, 0.0, 0))[0]:
                        worst[i] = (o, float(inner[j]) if places[j] and not c else math.nan, j)
                rows_ = list(worst)
                langs = [languages(texts[j], texts[j].lower().split())[0] for _, _, j in worst.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in rows_], pa.int64()), pa.array([sources[i] for i in rows_], pa.string()), pa.array([names[f]] * len(rows_), pa.string()), pa.array(langs, pa.string()), pa.array([worst[i][0] for i in rows_], pa.float64()), pa.array([worst[i][1] for i in rows_], pa.float64())],
                    names=["key", "source", "field_name", "lang", "odds", "inner"],
                )

    scored = rows.mapInArrow(score, "key long, source string, field_name string, lang string, odds double, inner double").groupBy("key", "source", "field_name").agg(F.min_by("lang", "odds").alias("lang"), F.min("odds").alias("odds"), F.min_by("inner", "odds").alias("inner")).persist()
    cuts = by_group(thresholds(scored))
    return scored.select(F.col("key").alias(key), F.col("source").alias(source), "field_name", "lang", "odds", (F.col("odds") < cuts).alias("cut"))


def thresholds(scored: DataFrame) -> dict[tuple[str, str], float]:
    """(column, language) -> threshold; language \"\" holds for a language without values."""
    size = int((HIGH - LOW) / STEP)
    place = lambda c: F.floor((F.greatest(F.lit(LOW), F.least(F.lit(HIGH - STEP / 2), c)) - LOW) / STEP).cast("int")
    two = F.array(F.struct(F.lit(0).alias("kind"), F.when(F.col("odds") > -90, place(F.col("odds"))).alias("bin")), F.struct(F.lit(1).alias("kind"), F.when(~F.isnan("inner"), place(F.col("inner"))).alias("bin")))
    counts = scored.select("field_name", "lang", F.explode(two).alias("b")).where("b.bin is not null").groupBy("field_name", "lang", "b.kind", "b.bin").count().collect()
    own: dict[tuple[str, str], np.ndarray] = {}
    for r in counts:
        for group in ((r.field_name, r.lang), (r.field_name, "")):
            own.setdefault(group, np.zeros((2, size)))[r.kind, r.bin] += r["count"]
    out = {}
    for (f, lang), h in own.items():
        whole = own[f, ""]
        out[f, lang] = threshold(*(h + LEAN * whole / np.maximum(whole.sum(1, keepdims=True), 1)))
    return out


def by_group(values: dict[tuple[str, str], float]) -> Column:
    """The threshold of each row's column and language."""
    if not values:
        return F.lit(LOW)
    known = F.create_map(*[x for (f, lang), t in values.items() for x in (F.lit(f"{f}|{lang}"), F.lit(t))])
    return F.coalesce(known[F.concat_ws("|", "field_name", "lang")], known[F.concat("field_name", F.lit("|"))], F.lit(LOW))


def truncation_rates(values: DataFrame, source: str = "source_file") -> DataFrame:
    """(source, field_name, n_values, n_cut, cut_rate)."""
    return values.groupBy(source, "field_name").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_rate"))
