"""Lines repeated across one source's documents.

A text is cut into chunks where a rolling hash over its normalised bytes says so, and at line breaks, which
the hash sees as a cut of their own: equal lines then fall into equal chunks wherever they stand.  Normalised
means lower case, no blanks, and every number as one sign.  Each task counts its chunks per source in memory
first; what is shuffled is one count per task, source and chunk.  A chunk is excessive in a source if it
stands in at least `least` distinct documents and in at least `share` of all of them.  Lines made of excessive
chunks only are candidates; their own document counts decide exactly.

Defined results: null and blank texts count as documents of their source and have no line; a null source is a
source of its own; documents delivered again under one id count once; a line without a letter is no case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, MASK = 4, np.uint32(15)  # bytes the rolling hash sees; one cut in sixteen positions on average
MOST_CHUNKS, MOST_SOURCES = 1_000_000, 200_000  # excessive chunks, and sources with any, that are broadcast; more are joined by source, `SALTS` parts to a source
SALTS = 32
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), seed=7) for i in range(256)], np.uint32)
_GEAR64 = np.array([xxhash.xxh64_intdigest(bytes([i]), seed=7) | 1 for i in range(256)], np.uint64)
_WIDE_BLANK = "[\\x{a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]+"
_WIDE_DIGIT = "[\\x{660}-\\x{669}\\x{6f0}-\\x{6f9}\\x{966}-\\x{96f}\\x{e50}-\\x{e59}\\x{ff10}-\\x{ff19}]"
_BLANK = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, 32])
_DIGIT = np.isin(np.arange(256), range(48, 58))


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): lower case, no blanks but line breaks, each number as one sign."""
    text = pc.utf8_lower(pc.fill_null(texts, ""))
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    for pattern, sign in ((_WIDE_BLANK, ""), (_WIDE_DIGIT, "0")):
        if pc.any(pc.match_substring_regex(text, pattern)).as_py():
            text = pc.replace_substring_regex(text, pattern, sign)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    digit = _DIGIT[data]
    solid = ~_BLANK[data]
    # Blanks go first, so that a number is a run of digits with no blank seen between; digits parted by a blank stay two numbers.
    again = np.zeros(len(data), bool)
    again[1:] = digit[1:] & digit[:-1]
    if len(data):
        again[np.minimum(offsets[:-1], len(data) - 1)] = False
    keep = solid & ~again
    kept = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(digit, np.uint8(48), data)[keep]
    return out, kept[offsets]


def chunk_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number, chunk hash, whether the line may have a letter) of every chunk, in order."""
    data, offsets = normalised(texts)
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    newline = data == 10
    start = np.zeros(n + 1, bool)
    start[offsets[:-1]] = True
    start[1:] |= newline
    start = start[:n]
    # The rolling hash sees the last bytes of a position; at a line break it sees a cut, wherever it stands.
    gear = _GEAR[data]
    gear[newline] = 0
    rolled = gear.copy()
    for k in range(1, WINDOW):
        rolled[k:] += gear[:-k] << np.uint32(3 * k)
    cut = ((rolled >> np.uint32(9)) & MASK) == 0
    begin = np.flatnonzero(start)
    # Within the first bytes of a line the window still holds the line before; no cut there, so that equal lines have equal chunks.
    for k in range(WINDOW - 1):
        early = begin + k
        cut[early[early < n]] = False
    first = start | newline
    first[1:] |= cut[:-1]
    piece = np.flatnonzero(first)
    size = np.diff(np.append(piece, n))
    inside = np.arange(n) - np.repeat(piece, size)
    power = np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    power = np.multiply.accumulate(power)
    digest = np.add.reduceat(_GEAR64[data] * power[inside], piece)
    solid = ~newline[piece]
    breaks = np.cumsum(newline)
    owner = np.searchsorted(offsets[1:], piece, side="right")
    base = np.where(offsets[:-1] > 0, breaks[np.maximum(offsets[:-1] - 1, 0)], 0)
    number = breaks[piece] - base[owner] + 1
    letter = ((data >= 97) & (data <= 122)) | (data >= 0xC2)  # other alphabets are told from signs at the exact check
    lettered = np.maximum.reduceat(letter, begin)[np.searchsorted(begin, piece, side="right") - 1]
    return owner[solid], number[solid], digest[solid], lettered[solid]


def _sources(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def excessive_chunks(docs: DataFrame, doc: str, source: str, text: str, least: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(source, chunk) seen excessively, and (source, documents, needed).

    A document delivered twice counts twice here: the counts are upper bounds, which loses no chunk; the exact
    count of lines follows on candidates alone.  So no text is ever shuffled to find its copies.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            owners = _sources(batch.column(0))
            owner, _, digest, lettered = chunk_lines(batch.column(1))
            owner, digest = owner[lettered], digest[lettered]
            if len(owner):
                number = {o: i for i, o in enumerate(dict.fromkeys(owners))}
                names, code = list(number), np.array([number[o] for o in owners])
                # Each chunk once for a document, then how many documents of a source have it; both by one hash of the pair.
                once = np.unique(digest * _PAIR + owner.astype(np.uint64), return_index=True)[1]
                source_of, digest = code[owner[once]], digest[once]
                _, first, counts = np.unique(digest * _PAIR + source_of.astype(np.uint64), return_index=True, return_counts=True)
                for c, d, k in zip(source_of[first].tolist(), digest[first].view(np.int64).tolist(), counts.tolist()):
                    seen[(names[c], d)] += k
            if len(seen) > 1_000_000:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    counts = docs.select(source, text).mapInArrow(count, "source string, chunk long, n long").groupBy("source", "chunk").agg(F.sum("n").alias("n"))
    needed = docs.groupBy(F.col(source).alias("source"), doc).agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("documents"))
    needed = needed.withColumn("needed", F.greatest(F.lit(least).cast("double"), F.col("documents") * F.lit(share)))
    # Only chunks that reach the least count travel on to the join with the sizes of the sources.
    often = counts.where(F.col("n") >= least).join(needed, counts.source.eqNullSafe(needed.source)).where(F.col("n") >= F.col("needed"))
    return often.select(counts.source, "chunk"), needed


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["source", "chunk", "n"])


def line_key(line: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"\s+", "", line.lower()))


def repeated_lines(docs: DataFrame, doc: str = "passage_id", source: str = "source_file", text: str = "text", least: int = 8, share: float = 0.1) -> DataFrame:
    """(doc, source, line_no, line): every occurrence of a line repeated excessively within its source."""
    docs = docs.select(F.col(doc).alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    chunks, needed = excessive_chunks(docs, "doc", "source", "text", least, share)
    # One row per source, with the chunks that it repeats: those of its documents' common lines.
    lists = chunks.groupBy("source").agg(F.collect_set("chunk").alias("chunks")).join(needed, chunks.source.eqNullSafe(needed.source)).select(chunks.source.alias("of"), "chunks", "needed").persist()
    filled = docs.where(F.col("text").isNotNull())
    n_chunks, n_sources = lists.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0)), F.count("*")).first()
    of = F.col("source").eqNullSafe(F.col("of"))
    if n_chunks <= MOST_CHUNKS and n_sources <= MOST_SOURCES:
        joined = filled.join(F.broadcast(lists), of)
    else:
        parts = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = filled.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).join(parts, of & (F.col("_salt") == F.col("_part")))
    joined = joined.select("doc", "source", "needed", "chunks", "text")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, names, needs, texts = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            owner, number, digest, lettered = chunk_lines(batch.column(4))
            known = batch.column(3)
            hot = np.zeros(len(digest), bool)
            bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
            flat, at = np.asarray(known.flatten()), np.asarray(known.offsets) - known.offsets[0].as_py()
            for i in range(len(ids)):
                s, e = bounds[i], bounds[i + 1]
                if e > s:
                    hot[s:e] = np.isin(digest[s:e].view(np.int64), flat[at[i] : at[i + 1]])
            if len(owner):
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])])
                begin = np.flatnonzero(new)
                whole = np.minimum.reduceat(hot.astype(np.int8), begin) > 0
                for o, k in zip(owner[begin][whole].tolist(), number[begin][whole].tolist()):
                    line = texts[o].split("\n")[k - 1]
                    if any(map(str.isalpha, line)):
                        out.append((ids[o], names[o], needs[o], k, line, xxhash.xxh64_intdigest(line_key(line).encode()) - 2**63))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.int64()))], names=["doc", "source", "needed", "line_no", "line", "key"])

    found = joined.mapInArrow(candidates, "doc string, source string, needed double, line_no int, line string, key long").persist()
    # The exact count runs on candidates alone; the keys of a hot source spread over its lines, and counts are partial before the shuffle.
    exact = found.select("source", "key", "needed", "doc").distinct().groupBy("source", "key", "needed").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("needed"))
    exact = exact.select(F.col("source").alias("of"), F.col("key").alias("of_key"))
    hits = found.join(exact, F.col("source").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left_semi")
    return hits.select(F.col("doc").alias(doc), F.col("source").alias(source), "line_no", "line")


def without_lines(docs: DataFrame, lines: DataFrame, doc: str = "passage_id", text: str = "text") -> DataFrame:
    """Each row of docs, its text without the lines listed, and how many went; rows delivered again are dropped before (plans.tables.delivered_once)."""
    gone = lines.groupBy(doc).agg(F.collect_set("line_no").alias("_gone"))
    kept = docs.drop("_gone").join(gone, doc, "left")
    parts = F.split(F.col(text), "\n", -1)
    left = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("_gone"), i + 1)), "\n"))
    return kept.withColumn(text, left).withColumn("lines_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_gone")
