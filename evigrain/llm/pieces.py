"""Oversized texts cut into pieces under a limit at natural boundaries, with overlap.

Every position of a text has a boundary strength (paragraph, line, sentence, clause, word, none).  A sparse
table over the strengths answers the strongest boundary in any window in constant time; of equally strong
ones the rightmost is taken.  The next piece starts `overlap` characters before the cut, and no window is
scanned twice, so a text of any length takes n log n steps in numpy and none per character in Python.

Defined results: null gives no piece; a text within the limit (empty too) is one piece; offsets and lengths
count code points; a text without any boundary is cut at the limit, never within a surrogate or a letter and
its combining mark if that can be avoided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2400, 250
# Strengths of a cut after a character.
NONE, LETTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_ENDS = np.array([ord(c) for c in ".!?。！？।؟…"], np.uint32)  # fixed values
_CLAUSES = np.array([ord(c) for c in ",;:，；：、–—"], np.uint32)  # fixed values
_CLOSERS = np.array([ord(c) for c in "\"')]}”’»」』）】"], np.uint32)  # fixed values
_BLANKS = np.array([9, 11, 12, 13, 32, 0xA0, 0x3000, *range(0x2000, 0x200B)], np.uint32)


def strengths(code: np.ndarray) -> np.ndarray:
    """Strength of the cut after each character."""
    n = len(code)
    after = np.concatenate([code[1:], [10]])
    later = np.concatenate([code[2:], [10, 10]])[:n]
    blank, newline = np.isin(code, _BLANKS), code == 10
    force = np.full(n, LETTER, np.int8)
    force[((after >= 0x300) & (after <= 0x36F)) | ((after >= 0xFE00) & (after <= 0xFE0F)) | (after == 0x200D) | (code == 0x200D)] = NONE
    force[blank] = WORD
    ideograph = (code >= 0x3040) & (code <= 0x9FFF) | (code >= 0x0E00) & (code <= 0x0E7F)
    before = np.concatenate([[0], code[:-1]])
    earlier = np.concatenate([[0, 0], code[:-2]])[:n] if n > 1 else np.zeros(n, code.dtype)
    force[blank & np.isin(before, _CLAUSES)] = CLAUSE
    force[np.isin(code, _CLAUSES) & ((code >= 0x3000) | (after >= 0x2E80))] = CLAUSE
    ended = np.isin(before, _ENDS) | (np.isin(before, _CLOSERS) & np.isin(earlier, _ENDS))
    force[blank & ended] = SENTENCE
    wide = (code == 0x3002) | (code == 0xFF01) | (code == 0xFF1F)
    force[wide & ~np.isin(after, _CLOSERS)] = SENTENCE
    force[np.isin(code, _CLOSERS) & ((before == 0x3002) | (before == 0xFF01) | (before == 0xFF1F)) & ~ideograph] = SENTENCE
    force[newline] = LINE
    force[newline & (after != 10) & (before == 10)] = PARAGRAPH
    force[newline & (after == 10)] = WORD
    del later
    return force


def sparse_table(keys: np.ndarray) -> list[np.ndarray]:
    """Level k holds the largest key of each window of 2**k places."""
    levels, step = [keys], 1
    while 2 * step <= len(keys):
        top = levels[-1]
        levels.append(np.maximum(top[:-step], top[step:]))
        step *= 2
    return levels


def strongest(levels: list[np.ndarray], low: int, high: int) -> int:
    """Place of the strongest boundary in [low, high], the rightmost among equals."""
    k = (high - low + 1).bit_length() - 1
    return int(max(levels[k][low], levels[k][high - (1 << k) + 1]) & 0xFFFFFFFF)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece; pieces hold at most `limit` characters."""
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    force = strengths(code)
    levels = sparse_table((force.astype(np.int64) << 32) | np.arange(n))
    out, start = [], 0
    while n - start > limit:
        # Half a piece at least, and more than the overlap, so that every step moves on.
        low = start + max(overlap + 1, limit // 2)
        at = strongest(levels, low - 1, start + limit - 1)
        out.append((start, at + 1, int(force[at])))
        start = at + 1 - overlap
    out.append((start, n, PARAGRAPH))
    return out


def split_oversized(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_char, end_char, cut_strength, piece): texts over the limit in pieces, one set for each row.

    Rows delivered again are dropped before (plans.tables.delivered_once): here that would shuffle every text.
    Texts within the limit never reach Python; they come out whole as piece 1.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    whole = rows.where(F.length("text") <= limit).select("key", F.lit(1).alias("piece_no"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.lit(PARAGRAPH).alias("cut_strength"), F.col("text").alias("piece"))
    return whole.unionByName(oversized_pieces(rows, "key", "text", limit, overlap)).withColumnRenamed("key", key)


def oversized_pieces(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of texts over the limit alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(k, i, s, e, f, t[s:e]) for k, t in zip(keys, texts) for i, (s, e, f) in enumerate(cut(t, limit, overlap), 1)]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [key, "piece_no", "start_char", "end_char", "cut_strength", "piece"]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    rows = df.where(F.length(text) > limit).select(F.col(key).cast("string").alias(key), text)
    return rows.mapInArrow(pieces, f"`{key}` string, piece_no int, start_char int, end_char int, cut_strength int, piece string")
