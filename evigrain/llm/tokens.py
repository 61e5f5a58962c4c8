"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPAN = 20_000  # characters encoded at once, or as many as there are up to the next place where the pattern parts any text
# A single blank between solid characters belongs to what follows; a letter after a full-width mark begins anew.
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=[。、，！？；：])(?=[^\W\d_])")


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a whole text; 0 for null and empty."""
    if not text:
        return 0
    encode, total, start = encoding(path).encode_ordinary, 0, 0
    while len(text) - start > SPAN and (m := _SAFE.search(text, start + SPAN)):
        total += len(encode(text[start : m.start()]))
        start = m.start()
    return total + len(encode(text[start:]))


def with_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY, also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `also` and n_tokens; the text itself goes no further."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, path) for t in batch.column(len(also)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*also, "n_tokens"])

    kept = df.select(*also, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(count, f"{fields}, n_tokens long")
