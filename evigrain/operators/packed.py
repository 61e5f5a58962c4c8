"""Several values packed in one field: one row per value, with its place in the field.

The scan works on the Arrow string buffers of a whole batch at once: byte masks mark quotation marks,
brackets and separators, cumulative sums give quote parity and bracket depth, the surviving separators
become child offsets of a list array, and flattening it yields values with their parent ordinals.  No
Python statement runs per byte or per value, except the name check on the few candidate boundaries that
lie inside a protected name.

Defined results for odd input: null, empty and blank fields hold no value and yield no row; a quotation
mark or bracket without its partner is an ordinary character; empty pieces between separators are dropped
and do not count as a place; repeated values are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED_FIELDS = ("predictor", "method", "effect_size", "performance")

# Separators and marks of more than one byte, with the control characters that stand for them in a scan.
WIDE_MARKS = (("；", "\x01"), ("、", "\x02"), ("»", "\x03"), ("•", "\x04"), ("“", "\x05"), ("”", "\x06"), ("，", "\x07"))
STRONG = b";|\x01\x02\x03\n\r\t\x07"
HARD = b"\n\r\t"
OPENING, CLOSING = b"([{", b")]}"
# A piece after a comma that limits or describes the value before it.
QUALIFIER = r"^,\s*(?:[pP]\s*[=<>≤≥]|\d+\s*%\s*CI\b|CI\b)"
PLAIN_QUALIFIER = r"^,\s*[a-z][^0-9]*$"


def _table(chars: bytes) -> np.ndarray:
    hit = np.zeros(256, bool)
    hit[list(chars)] = True
    return hit


_STRONG, _HARD, _OPEN, _CLOSE = _table(STRONG), _table(HARD), _table(OPENING), _table(CLOSING)
_DIGIT = _table(b"0123456789")
_WORD = _table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_EDGE = _table(b"\x00 " + STRONG + b",()[]&+/")


def edit_distance(a: str, b: str, limit: int = 99) -> int:
    """Edits between two strings (a swap of neighbours is one); limit + 1 if there are more than limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > limit:
            return limit + 1
        older, row = row, new
    return row[-1]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class NameGuard:
    """Names that contain a separator themselves ("A, total", "A and B grade") and so must not be cut there."""

    def __init__(self, names: Sequence[str]):
        self.halves = []
        for name in names:
            for m in re.finditer(r",| and | & | \+ | / ", name):
                left, right = _words(name[: m.start()]), _words(name[m.end() :])
                if left and right:
                    self.halves.append((left, right))

    def joins(self, before: str, after: str) -> bool:
        """Whether the cut between these two pieces falls inside a name; one slip in each half at most for short, two for long ones."""
        a, b = _words(before), _words(after)
        b = b[1:] if after[:5].lower() == " and " else b
        for left, right in self.halves:
            x, y = "".join(a[-len(left) :]), "".join(b[: len(right)])
            p, q = "".join(left), "".join(right)
            if edit_distance(x, p, k := min(2, len(p) // 3)) <= k and edit_distance(y, q, k := min(2, len(q) // 2)) <= k:
                return True
        return False


def _prepare(values: pa.Array) -> pa.Array:
    """List marks become line breaks, a JSON list a quoted list, wide marks single bytes."""
    text = pc.fill_null(values.cast(pa.string()), "")
    for wide, narrow in WIDE_MARKS:
        text = pc.replace_substring(text, wide, narrow)
    listed = pc.match_substring_regex(text, r'^\s*\[\s*".*"\s*\]\s*$')
    if pc.any(listed).as_py():
        inner = pc.replace_substring(pc.replace_substring_regex(text, r'^\s*\[\s*("(?s:.*)")\s*\]\s*$', r"\1"), '\\"', '""')
        coded = pc.and_(listed, pc.match_substring(text, "\\u"))
        if pc.any(coded).as_py():
            inner = pa.array([_plain_list(t.as_py()) if c else i.as_py() for t, i, c in zip(text, inner, coded.to_pylist())], pa.string())
        text = pc.if_else(listed, inner, text)
    for closing in (r"\)", r"\."):
        numbered = pc.match_substring_regex(text, rf"^\s*\(?1{closing}\s")
        if pc.any(numbered).as_py():
            text = pc.if_else(numbered, pc.replace_substring_regex(text, rf"(^|[\s;,])\(?\d{{1,2}}{closing}\s+", "\\1\n"), text)
    marked = pc.match_substring_regex(text, r"^\s*\x04")
    text = pc.if_else(marked, pc.replace_substring(text, "\x04", "\n"), text)
    dashed = pc.match_substring_regex(text, r"^\s*[-*–]\s")
    return pc.if_else(dashed, pc.replace_substring_regex(text, r"(^|\n)\s*[-*–]\s+", "\n"), text)


def _plain_list(text: str) -> str:
    try:
        return ",".join('"' + str(v).replace('"', '""') + '"' for v in json.loads(text))
    except ValueError:
        return text


def _parity(flag: np.ndarray, starts: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sum of flag within each row; rows that do not end at an even (or zero) sum count as zero throughout."""
    total = np.cumsum(flag)
    first = np.where(lengths > 0, total[np.minimum(starts, len(flag) - 1)] - flag[np.minimum(starts, len(flag) - 1)], 0)
    return total - first[row]


def split_array(values: pa.Array, plain: bool, guard: NameGuard) -> pa.ListArray:
    """The values of every field, as a list array; plain: a lower-case piece without digits after a comma is a qualifier."""
    text = _prepare(values)
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    rows = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + rows + 1].astype(np.int64)
    if rows == 0 or offsets[-1] == offsets[0]:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, lengths = offsets[:-1], np.diff(offsets)
    row = np.repeat(np.arange(rows), lengths)
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    after = np.concatenate([data[1:], [0]]).astype(np.uint8)
    full = lengths > 0
    before[starts[full]] = 0
    after[offsets[1:][full] - 1] = 0
    last = np.where(full, offsets[1:] - 1, 0)

    def balanced(depth: np.ndarray, period: int) -> np.ndarray:
        end = depth[last] % 2 if period else depth[last]
        return np.where((full & (end == 0))[row], depth % 2 if period else depth, 0)

    quoted = balanced(_parity(((data == 34) & (before != 92)).astype(np.int64), starts, row, lengths), 1)
    curly = balanced(_parity((data == 5).astype(np.int64) - (data == 6), starts, row, lengths), 0)
    tick = data == 39
    single = balanced(_parity((tick & _EDGE[before] & _WORD[after]).astype(np.int64) - (tick & _EDGE[after] & ~_EDGE[before]), starts, row, lengths), 0)
    free = (quoted == 0) & (curly <= 0) & (single <= 0)
    depth = balanced(_parity((_OPEN[data] & free).astype(np.int64) - (_CLOSE[data] & free), starts, row, lengths), 0)
    free &= depth <= 0

    strong = _STRONG[data] & free
    hard = np.zeros(rows, bool)
    hard[row[strong & _HARD[data]]] = True
    comma = (data == 44) & free & ~(_DIGIT[before] & _DIGIT[after])
    low = data | 32
    at = np.flatnonzero((data == 32) & free)
    spaced = np.zeros(len(data), np.int64)
    if len(at):
        pad = np.concatenate([data, np.zeros(5, np.uint8)])
        rest = offsets[1:][row[at]] - at
        sign = (rest > 2) & np.isin(pad[at + 1], np.frombuffer(b"&+/", np.uint8)) & (pad[at + 2] == 32)
        spaced[at[sign]] = 3
        padlow = np.concatenate([low, np.zeros(5, np.uint8)])
        both = (rest > 4) & (padlow[at + 1] == 97) & (padlow[at + 2] == 110) & (padlow[at + 3] == 100) & (pad[at + 4] == 32)
        spaced[at[both]] = 5
    weak = (comma | (spaced > 0)) & ~hard[row]
    width = np.where(strong | comma, 1, spaced)
    cuts = np.flatnonzero(strong | weak)

    # Each piece begins with its separator, so that the array needs no copy; cuts that fall inside a value are then taken back.
    begins = np.concatenate([starts, cuts])
    order = np.argsort(begins, kind="stable")
    begins, cut = begins[order], (order >= rows)
    pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, offsets[-1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    drop = cut & _flag(pc.match_substring_regex(pieces, QUALIFIER))
    if plain:
        drop |= cut & _flag(pc.match_substring_regex(pieces, PLAIN_QUALIFIER))
    drop &= ~np.isin(before[np.minimum(begins, len(data) - 1)], (34, 39, 6))  # a value in quotation marks ends with them
    if guard.halves:
        for i in np.flatnonzero(cut & ~drop & weak[np.minimum(begins, len(data) - 1)]):
            if guard.joins(pieces[i - 1].as_py(), pieces[i].as_py()):
                drop[i] = True
    begins, cut = begins[~drop], cut[~drop]
    keep = np.ones(len(data) + 1, np.int64)
    for extra in range(5):
        gone = begins[cut & (width[np.minimum(begins, len(data) - 1)] > extra)] + extra
        keep[gone] = 0
    keep[-1] = 0
    kept = np.concatenate([[0], np.cumsum(keep[:-1])])
    child = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(kept[begins], kept[-1]).astype(np.int32)), pa.py_buffer(data[keep[:-1] == 1].copy()))
    child = _unquote(pc.utf8_trim_whitespace(child))
    owner = np.searchsorted(np.flatnonzero(~cut), np.arange(len(begins)), side="right") - 1
    some = _flag(pc.not_equal(child, ""))
    counts = np.bincount(owner[some], minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), child.filter(pa.array(some)))


def _flag(mask: pa.Array) -> np.ndarray:
    return np.asarray(mask.to_numpy(zero_copy_only=False), bool)


def _unquote(child: pa.Array) -> pa.Array:
    """Enclosing quotation marks go, a doubled mark inside becomes one, wide marks come back."""
    double = pc.match_substring_regex(child, r'(?s)^".*"$')
    inner = pc.replace_substring(pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(child, 1, -1)), '""', '"')
    child = pc.if_else(double, inner, child)
    other = pc.match_substring_regex(child, r"(?s)^(?:'.*'|\x05.*\x06)$")
    child = pc.if_else(other, pc.utf8_trim_whitespace(pc.utf8_slice_codeunits(child, 1, -1)), child)
    for wide, narrow in WIDE_MARKS:
        child = pc.replace_substring(child, narrow, wide)
    return child


def split_packed(df: DataFrame, key: str, fields: Sequence[str] = PACKED_FIELDS, names: Sequence[str] = ()) -> DataFrame:
    """(key, field_name, item_no, n_items, item_text): one row per value of each field, its place counted from 1.

    names: values that may contain a separator and stay whole; at most a few thousand, they travel in the task.
    Rows with the same key and content count once.
    """
    key_type = df.schema[key].dataType.simpleString()
    guard = NameGuard(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields, 1):
                lists = split_array(batch.column(i), field != "predictor", guard)
                parent = pc.list_parent_indices(lists)
                at = np.asarray(parent)
                place = np.arange(len(at)) - np.asarray(lists.offsets)[:-1][at] + 1 if len(at) else np.zeros(0)
                of = np.diff(np.asarray(lists.offsets))[at] if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(parent), pa.array([field] * len(at), pa.string()), pa.array(place.astype(np.int32)), pa.array(of.astype(np.int32)), lists.flatten()],
                    names=[key, "field_name", "item_no", "n_items", "item_text"],
                )

    rows = df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).distinct()
    return rows.mapInArrow(scan, f"`{key}` {key_type}, field_name string, item_no int, n_items int, item_text string")
